"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import checkpoint, read, scratch, ship, worker_cache
from papyra.llm.components import components

#: A signature has K symbols of 16 bits. At similarity 0.8 the symbols that differ number 12.8 on average, with a
#: deviation of 3.2; pairs with at most DISTANCE are all found (beyond: about 1 in 10,000 pairs at exactly 0.8).
K, DISTANCE, CHUNKS = 64, 25, 13
#: Rounds in which each unresolved node is held against one pivot of its buckets, before all that is left is compared.
STAR_ROUNDS = 3
#: Chunks whose buckets are compared together after that. Few at first: what they connect needn't be compared again.
CHUNK_TURNS = ((0,), (1, 2), (3, 4, 5, 6), tuple(range(7, CHUNKS)))
#: Nodes, and shingles of nodes, of a bucket that are compared with each other in one task; larger buckets are dealt to
#: several by blocks. Columns of the matrices they are compared by.
BLOCK, BLOCK_SHINGLES, COLUMNS = 2048, 1_000_000, 4096
#: Most nodes by which the texts are filtered with a broadcast (16 bytes each); beyond, that join shuffles.
BROADCAST_NODES = 1_000_000
#: Bits of the broadcast filter of shared keys, at most.
FILTER_BITS = 1 << 28

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)


class WordHashes(dict):
    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, of the whole sequence; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_cache("words", WordHashes).__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _PRIME + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


_SYMBOLS = np.array_split(np.arange(K), CHUNKS)
#: The last bits of a key: its chunk, and before that its mask's number in the chunk.
_CHUNK_BITS, _MASK_BITS = 4, 3


def _masks() -> list[tuple[int, int, int, np.ndarray]]:
    """(number, chunk, number in the chunk, kept symbols): each chunk with each way to leave out DISTANCE // CHUNKS symbols.

    Of CHUNKS chunks, one has at most DISTANCE // CHUNKS = 1 errors (pigeonhole); leaving each of its symbols out in
    turn enumerates them, so two signatures within DISTANCE share at least one key.
    """
    assert DISTANCE // CHUNKS == 1 and CHUNKS <= 1 << _CHUNK_BITS and max(map(len, _SYMBOLS)) <= 1 << _MASK_BITS
    out = []
    for at, chunk in enumerate(_SYMBOLS):
        out += [(at, i, np.delete(chunk, i)) for i in range(len(chunk))]
    return [(i, *mask) for i, mask in enumerate(out)]


_MASKS = _masks()


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, sigs = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["_id", "_n", "_set", "_sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            nodes = part.column(0).to_numpy()
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, K).astype(np.uint64)
            keys = np.empty((len(nodes), len(_MASKS)), np.uint64)
            for i, chunk, place, kept in _MASKS:
                h = np.full(len(nodes), i + 1, np.uint64)
                for j in kept:
                    h = _mix(h * _PRIME + sig[:, j])
                keys[:, i] = h >> np.uint64(_CHUNK_BITS + _MASK_BITS) << np.uint64(_CHUNK_BITS + _MASK_BITS) | np.uint64(place << _CHUNK_BITS | chunk)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes, len(_MASKS)))], ["_key", "_c"])


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), n) for t in part.column(1)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["_set", "_shingles"])

    return run


def _matches(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a are similar enough to which of b: sizes of all intersections by products of 0/1 matrices."""
    na, nb = (np.array([len(s) for s in side]) for side in (a, b))
    common = np.intersect1d(*(np.unique(np.concatenate(side)) for side in (a, b)), assume_unique=True)

    def cells(side: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(side)
        at = np.minimum(np.searchsorted(common, every), max(len(common) - 1, 0))
        hit = common[at] == every if len(common) else np.zeros(len(every), bool)
        return np.repeat(np.arange(len(n)), n)[hit], at[hit]

    (ra, ca), (rb, cb) = cells(a, na), cells(b, nb)
    shared = np.zeros((len(a), len(b)), np.float32)  # whole numbers below 2**24 are exact
    for low in range(0, len(common), COLUMNS):
        parts = []
        for rows, columns, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            own = (columns >= low) & (columns < low + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(common) - low)), np.float32)
            m[rows[own], columns[own] - low] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    shared = shared.astype(np.int64)
    return 100 * shared >= percent * (na[:, None] + nb[None, :] - shared)


def cell_links(comp_a: np.ndarray, sets_a: list[np.ndarray], comp_b: np.ndarray, sets_b: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(component, smallest component that links of this cell connect it with), for those that aren't that one."""
    ok = _matches(sets_a, sets_b, percent)
    labels, back = np.unique(np.concatenate([comp_a, comp_b]), return_inverse=True)
    ia, ib = back[: len(comp_a)], back[len(comp_a) :]
    least = np.arange(len(labels))
    none = len(labels)
    while True:
        was = least.copy()
        np.minimum.at(least, ia, np.where(ok, least[ib][None, :], none).min(axis=1, initial=none))
        np.minimum.at(least, ib, np.where(ok, least[ia][:, None], none).min(axis=0, initial=none))
        least = least[least]
        if (was == least).all():
            return [(int(labels[i]), int(labels[j])) for i, j in enumerate(least) if i != j]


def _by_cell(rows: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, tuple[list, ...], tuple[list, ...]]]:
    """(cell, columns of side 0, columns of side 1) of rows that come sorted by cell (_key, _i, _j), then _side, then columns."""
    cell, sides = None, ()
    for batch in rows:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        side = batch.column(3).to_pylist()
        values = [batch.column(4 + k) if pa.types.is_list(batch.column(4 + k).type) else batch.column(4 + k).to_pylist() for k in range(columns)]
        for i, key in enumerate(keys):
            if key != cell:
                if cell is not None and sides[0][0] and sides[1][0]:
                    yield cell, *sides
                cell, sides = key, tuple(tuple([] for _ in range(columns)) for _ in range(2))
            for held, value in zip(sides[side[i]], values, strict=True):
                x = value[i]
                held.append(x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x)
    if cell is not None and sides[0][0] and sides[1][0]:
        yield cell, *sides


def first_met(key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of signatures that share the key, those that share no key of an earlier mask, so that each pair is tested once."""
    chunk, place = key & (1 << _CHUNK_BITS) - 1, key >> _CHUNK_BITS & (1 << _MASK_BITS) - 1
    left = np.arange(len(a))
    for symbols in _SYMBOLS[:chunk]:
        left = left[(a[left][:, symbols] != b[left][:, symbols]).sum(axis=1) > 1]
    if place:  # with no error in the chunk a pair shares its first mask; with one, only the mask that leaves it out
        left = left[(a[left][:, _SYMBOLS[chunk]] != b[left][:, _SYMBOLS[chunk]]).any(axis=1)]
    return left


def _candidates(percent: int):
    """Of cells of (_comp, _m, _sig, _c), the nodes that have a pair to test: in different components, of sizes that may do, within DISTANCE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), one, two in _by_cell(batches, 4):
            ca, cb = np.array(one[0]), np.array(two[0])
            ma, mb = np.array(one[1]), np.array(two[1])
            sa, sb = (np.frombuffer(b"".join(side[2]), np.uint16).reshape(-1, K) for side in (one, two))
            keep_a, keep_b = np.zeros(len(ca), bool), np.zeros(len(cb), bool)
            step = max(1, (1 << 17) // len(cb))
            for low in range(0, len(ca), step):
                part = slice(low, low + step)
                ok = (ca[part, None] != cb) & (100 * np.minimum(ma[part, None], mb) >= percent * np.maximum(ma[part, None], mb))
                x, y = np.nonzero(ok)
                x += low
                near = (sa[x] != sb[y]).sum(axis=1) <= DISTANCE
                x, y = x[near], y[near]
                own = first_met(key, sa[x], sb[y])
                keep_a[x[own]] = keep_b[y[own]] = True
            for side, (rows, keep) in enumerate(((one, keep_a), (two, keep_b))):
                at = np.flatnonzero(keep)
                if len(at):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array((ca, cb)[side][at]), pa.array([rows[3][k] for k in at], pa.int64())], ["_key", "_i", "_j", "_side", "_comp", "_c"])

    return run


def _links(percent: int):
    """The links of each cell of (_comp, _shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ca, sa), (cb, sb) in _by_cell(batches, 2):
            if found := cell_links(np.array(ca), sa, np.array(cb), sb, percent):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a text's set is its distinct n-word shingles
    (fewer words: the whole sequence as one; null, empty and blank texts: none, linked with nothing). Rows are linked
    when 100 * intersection >= percent * union of the full sets. component_id is the smallest id reachable; the row
    with it is kept. Rows with a null id have a null component_id and aren't kept, but link others. Rows that repeat
    an id are separate rows, all kept if their id is the component's. An empty table gives an empty result; other
    columns are ignored.

    Equal sets become one node. Nodes in a common bucket of the multi-index are candidates. Within buckets that hold
    several components, nodes are first held against one pivot each (STAR_ROUNDS times), then whatever still differs
    in component is compared on full sets, block by block: no link between different components goes untested, and
    a block emits at most one row for each of its components. percent below 80 needs a larger DISTANCE.
    """
    if percent < 80:
        raise ValueError("signatures are sized for a similarity of 0.8 or more")
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    with scratch(df.sparkSession) as keep:
        prints = checkpoint(source.mapInArrow(_fingerprints(n), f"_id {kind}, _n bigint, _set binary, _sig binary").withColumn("_c", _number("_set")))
        prints, rows = _nodes(prints)
        labels = _label(source, rows, n, percent)
        node = checkpoint(rows.select("_c", "_rep").join(labels, F.col("_c") == F.col("u"), "left").select("_c", "_rep", F.coalesce("label", "_c").alias("_label")))
        # A component's smallest id is a partial aggregate; the joins that bring it back split hot components and copies.
        least = checkpoint(node.groupBy("_label").agg(F.min("_rep").alias("_least")))
        node = checkpoint(node.join(least, "_label").select("_c", "_least"))
        keep(prints, node)
    some = prints.where("_set is not null").select("_id", "_n", "_c").join(node, "_c")
    none = prints.where("_set is null").select("_id", "_n", F.col("_id").alias("_least"))
    out = some.select("_id", "_n", "_least").unionByName(none)
    own = F.when(F.col("_id").isNotNull(), F.col("_least"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("_id") == own, F.lit(False)).alias("kept"))


def _number(column: str, salt: int | None = None) -> Column:
    return F.xxhash64(column) if salt is None else F.xxhash64(F.lit(salt), column)


def _nodes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prints, a row for each different set), with a number for each set: its 64-bit hash, made anew where 128-bit digests tell
    that unlike sets share one. Such sets are few whatever the number of texts (some hundred of 10**11)."""
    for salt in range(100):
        found = prints.where("_set is not null").groupBy("_c").agg(F.min("_id").alias("_rep"), F.min("_set").alias("_set"), F.max("_set").alias("_other"), F.first("_sig").alias("_sig"), F.first("_n").alias("_m"))
        rows = checkpoint(found)
        clash = rows.where("_set != _other").select("_c", F.lit(True).alias("_clash"))
        if clash.isEmpty():
            return prints, rows.drop("_other")
        prints = checkpoint(prints.join(_few(clash), "_c", "left").withColumn("_c", F.when(F.col("_clash"), _number("_set", salt)).otherwise(F.col("_c"))).drop("_clash"))
    raise RuntimeError("numbers of sets clash time and again")


def _label(source: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, label) of the nodes that are linked: label is the same for all nodes of a component, and one of them.

    Tables that meet in a join are written before, or shuffled for that join alone, so that adaptive execution can
    split the rows of a hot key. A component label that nodes share says that links connect them (not that all that
    links connect share it): it only saves comparisons. What it leaves open is joined up at the end.
    """
    with scratch(source.sparkSession) as keep:
        keys = checkpoint(rows.select("_c", "_sig").mapInArrow(_keys, "_key bigint, _c bigint"))
        shared = checkpoint(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").select("_key"))
        state = checkpoint(_perhaps(keys, shared).join(shared, "_key").select("_key", "_c", F.col("_c").alias("_comp")))
        keep(state)
    sets = checkpoint(_sets_of(source, rows, state, n))
    links = None

    def open_keys(state: DataFrame, chunks: tuple[int, ...] = (), turn: int = 0) -> DataFrame:
        """Keys whose bucket holds several components."""
        own = state.where(F.col("_key").bitwiseAND(F.lit((1 << _CHUNK_BITS) - 1)).isin(*chunks)) if chunks else state
        pivot = F.min_by(F.struct("_c", "_comp"), F.xxhash64("_c", F.lit(turn)))
        return checkpoint(own.groupBy("_key").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high"), pivot.alias("_pivot")).where("_low != _high").select("_key", "_pivot"))

    def hooked(state: DataFrame, found: DataFrame) -> DataFrame:
        hook = checkpoint(found.groupBy(F.greatest("a", "b").alias("_comp")).agg(F.min(F.least("a", "b")).alias("_to")))
        for _ in range(2):
            state = state.join(hook, "_comp", "left").select("_key", "_c", F.coalesce("_to", "_comp").alias("_comp"))
        return checkpoint(state)

    for turn in range(STAR_ROUNDS):
        keys_left = open_keys(state, turn=turn)
        if keys_left.isEmpty():
            break
        pairs = state.join(keys_left, "_key").where("_pivot._comp != _comp").groupBy("_c").agg(F.min("_comp").alias("a"), F.min("_pivot").alias("_p"))
        pairs = pairs.select(F.col("_c").alias("u"), F.col("_p._c").alias("v"), "a", F.col("_p._comp").alias("b"))
        with scratch(source.sparkSession) as keep:
            found = checkpoint(_confirm(pairs, sets, percent).select("a", "b"))
            state = hooked(state, found)
            keep(found, state)
        links = found if links is None else links.unionByName(found)
    for chunks in CHUNK_TURNS:
        keys_left = open_keys(state, chunks)
        if keys_left.isEmpty():
            continue
        with scratch(source.sparkSession) as keep:
            found = checkpoint(_cells(state, keys_left, rows, sets, percent).mapInArrow(_links(percent), "a bigint, b bigint").distinct())
            state = hooked(state, found)
            keep(found, state)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select(F.col("_c").alias("u"), F.col("_c").alias("label")).limit(0)
    nodes = checkpoint(state.select("_c", "_comp").distinct())
    # A component is named by one of its nodes, so links between components are links between nodes.
    of = lambda end, out: nodes.select(F.col("_c").alias(end), F.col("_comp").alias(out))
    rest = links.join(of("a", "u"), "a").join(of("b", "v"), "b").where("u != v").select("u", "v")
    return nodes.join(components(rest).withColumnRenamed("u", "_comp"), "_comp", "left").select(F.col("_c").alias("u"), F.coalesce("label", "_comp").alias("label"))


def _perhaps(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """keys without most of those that aren't in shared, by a broadcast filter of a bit for each shared key: at most FILTER_BITS
    bits, however many keys there are (a fuller filter only lets more rows pass on to the join)."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << max(1, 32 * shared.count() - 1).bit_length()))
    h = F.xxhash64("_key")
    word, bit = F.pmod(h, F.lit(bits // 64)).alias("_word"), F.shiftrightunsigned(h, 58).cast("int").alias("_bit")
    mask = shared.select(word, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask"))
    probed = keys.select("*", word, bit).join(F.broadcast(mask), "_word")
    return probed.where(F.expr("(_mask & shiftleft(1L, _bit)) != 0")).select("_key", "_c")


def _sets_of(source: DataFrame, rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """(_c, _shingles) of the nodes that share a bucket, from the text of each node's first row."""
    wanted = checkpoint(rows.join(state.select("_c").distinct(), "_c").select("_rep").distinct())
    texts = source.join(_few(wanted), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("_id", "_text")
    sets = texts.mapInArrow(_set_rows(n), "_set binary, _shingles array<bigint>")
    return sets.where("_set is not null").dropDuplicates(["_set"]).join(rows.select("_set", "_c"), "_set").select("_c", "_shingles")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v, and their components a, b) whose full sets are similar enough."""
    pairs = checkpoint(pairs)

    def of(end: str) -> DataFrame:
        """The sets of one end; those of nodes that no pair has don't move, while the nodes that have one are few."""
        nodes = checkpoint(pairs.select(F.col(end).alias("_c")).distinct())
        own = sets.join(F.broadcast(nodes), "_c", "left_semi") if nodes.count() <= BROADCAST_NODES else sets
        return own.select(F.col("_c").alias(end), F.col("_shingles").alias(f"_{end}"))

    both = pairs.join(of("u"), "u").join(of("v"), "v")
    both = both.select("u", "v", "a", "b", F.size(F.array_intersect("_u", "_v")).cast("long").alias("_i"), (F.size("_u") + F.size("_v")).cast("long").alias("_t"))
    return both.where(100 * F.col("_i") >= percent * (F.col("_t") - F.col("_i"))).select("u", "v", "a", "b")


def _sorted(cells: DataFrame) -> DataFrame:
    return cells.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")


def _cells(state: DataFrame, keys: DataFrame, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (_key, _i, _j, _side, _comp, _shingles) sorted by cell: of every bucket left, each block of nodes against each.

    The largest component of a bucket isn't compared with itself: its rows only face the others'. Signatures go first;
    only nodes that have a pair to test in a cell are followed by their sets.
    """
    left = checkpoint(state.join(keys.select("_key"), "_key"))
    wanted = checkpoint(left.select("_c").distinct())
    own = checkpoint(rows.select("_c", "_m", "_sig").join(_few(wanted), "_c", "left_semi"))
    left = checkpoint(left.join(own.select("_c", "_m"), "_c"))
    comps = left.groupBy("_key", "_comp").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_m").alias("_m"))
    top = checkpoint(comps.groupBy("_key").agg(F.max(F.struct("_m", "_rows", "_comp")).alias("_top"), F.sum("_m").alias("_sum"), F.sum("_rows").alias("_all")))
    blocks = lambda rows, m: F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(m / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    left = left.join(top, "_key").select(
        "_key", "_c", "_comp", "_m", (F.col("_comp") == F.col("_top._comp")).alias("_major"), blocks(F.col("_top._rows"), F.col("_top._m")).alias("_x"),
        blocks(F.col("_all") - F.col("_top._rows"), F.col("_sum") - F.col("_top._m")).alias("_y"),
    )
    h = F.xxhash64("_c", F.lit("b"))
    left = left.withColumn("_block", F.when(F.col("_major"), F.pmod(h, F.col("_x"))).otherwise(F.pmod(h, F.col("_y"))).cast("int"))
    # Columns of cells: 0.._x-1 hold blocks of the largest component, _x.._x+_y-1 blocks of the others, from the diagonal on.
    place = lambda i, j, side: F.struct(i.alias("_i"), j.alias("_j"), F.lit(side).alias("_side"))
    own_block = F.col("_block")
    along = F.when(F.col("_major"), F.transform(F.sequence(F.lit(0), F.col("_y") - 1), lambda i: place(i, own_block, 1))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("_x") - 1), lambda j: place(own_block, j, 0)),
            F.transform(F.sequence(own_block, F.col("_y") - 1), lambda j: place(own_block, F.col("_x") + j, 0)),
            F.transform(F.sequence(F.lit(0), own_block), lambda i: place(i, F.col("_x") + own_block, 1)),
        )
    )
    cells = left.select("_key", "_c", "_comp", "_m", F.explode(along).alias("_cell")).join(own.select("_c", "_sig"), "_c")
    cells = _sorted(cells.select("_key", "_cell._i", "_cell._j", "_cell._side", "_comp", "_m", "_sig", "_c"))
    open_cells = checkpoint(cells.mapInArrow(_candidates(percent), "_key bigint, _i int, _j int, _side int, _comp bigint, _c bigint"))
    needed = checkpoint(open_cells.select("_c").distinct())
    own = checkpoint(sets.join(_few(needed), "_c", "left_semi"))
    return _sorted(open_cells.join(own, "_c").select("_key", "_i", "_j", "_side", "_comp", "_shingles"))


def _few(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), n=4)
