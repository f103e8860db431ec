"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets x and y with Jaccard similarity of at least t share at least ceil(t |x|) and ceil(t |y|) elements. In any
common order of elements, the first l shared ones then lie among the first |x| - ceil(t |x|) + l elements of x, and
likewise of y. So each document has a prefix of its own l, longer where that is estimated to cost less, and two
documents are candidates only if their prefixes share at least the smaller of their two l. Elements are ordered by
rising document frequency; those that occur once stand first and need never be joined."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_batches, list_parts, map_arrow, materialize, ragged_take, shuffle_partitions, text_chunks, texts_of, without_ids
from .components import connected_components

#: Longest extra prefix tried, and the estimated cost of verifying a candidate in units of one posting.
MOST_MATCHES, VERIFY_COST = 12, 8
#: Documents, and shingles, that one block compares at a time.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
#: Copies from which on a set is joined to its rows by broadcast.
HOT_COPIES = 256
#: Keys whose counts one task holds at a time.
HELD_KEYS = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct k-word shingles. Words are runs of other characters than
    space and \\x09-\\x0D, A-Z in lower case; fewer than k words are one shingle; no words, none."""
    flat, offsets = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    at = coded.indices.to_numpy()
    full = np.fromiter((bool(w) for w in distinct), bool, len(distinct))[at] if len(at) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    words = hashes[at[full]] if len(at) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * _ODD + words[j : j + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(words[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(words[:0])
    return out


def _key(own: np.ndarray) -> int:
    """One number for a set, as signed 64 bits."""
    return int(np.int64(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)))


def needed(n: int, num: int, den: int) -> int:
    """Elements that a set of n must share with any set that is similar to it."""
    return -(-n * num // den)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole):
                sets = shingle_sets(texts_of(batch), k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n", "key"])

    return run


def _sampled(k: int):
    """Rows (h, key) of a quarter of all shingles; what a chunk of texts shows to be shared is one row with key null, so
    no shingle has more rows than there are chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole):
                sets = {_key(s): s[(s & np.uint64(3)) == 0] for s in shingle_sets(texts_of(batch), k) if len(s)}
                if not sets:
                    continue
                h = np.concatenate(list(sets.values()))
                keys = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(s) for s in sets.values()])
                h, first, count = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[first], mask=count > 1)], names=["h", "key"])

    return run


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """From rows (h, key) sorted by h: for each shingle that one key alone has, this key, batch by batch. Of a shingle
    that goes on in the next batch only its first key is held, and whether another has been met."""
    last, last_key, last_bad = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        bad = batch.column("key").is_null().to_numpy(zero_copy_only=False).copy()
        key = pc.fill_null(batch.column("key"), 0).to_numpy()
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(starts, len(h)))
        first = key[starts].copy()
        if h[0] == last:
            first[0] = last_key
        elif last is not None and not last_bad:
            yield np.array([last_key])
        bad |= key != np.repeat(first, sizes)
        torn = np.maximum.reduceat(bad, starts)
        if h[0] == last:
            torn[0] |= last_bad
        last, last_key, last_bad = h[-1], first[-1], bool(torn[-1])
        yield first[:-1][~torn[:-1]]
    if last is not None and not last_bad:
        yield np.array([last_key])


def _lonely(buckets: int):
    """From all rows (h, key) of a partition sorted by h: how many shingles of each key no other key has. The counts are
    packed by a hash of the key, one row for each bucket and HELD_KEYS keys."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (_mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[order], counts[order].astype(np.int32), bucket[order]
        which, first = np.unique(bucket, return_index=True)
        offsets = pa.array(np.append(first, len(keys)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(which), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(counts))], names=["bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for keys in _alone(batches):
            held.append(keys)
            n += len(keys)
            if n >= 4 * HELD_KEYS:
                merged = np.concatenate(held)
                if len(np.unique(merged)) >= HELD_KEYS:
                    yield packed(held)
                    held, n = [], 0
                else:
                    held, n = [merged], 0
        if any(map(len, held)):
            yield packed(held)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed counts of a partition by bucket, added up: one row for each key of the partition."""
    keys, alone = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        if b.num_rows:
            keys, at = np.unique(np.concatenate([keys, b.column("keys").flatten().to_numpy()]), return_inverse=True)
            alone = np.bincount(at, np.concatenate([alone, b.column("counts").flatten().to_numpy()])).astype(np.int64)
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(alone)], names=["key", "alone"])


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole):
                sets = {_key(s): s for s in shingle_sets(texts_of(batch), k) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64()))], names=["key", "tokens"])

    return run


def choose_matches(counts: np.ndarray, base: int) -> int:
    """The l of a document whose shared shingles have these frequencies (rising), `base` of them in its prefix for l = 1.

    Reading the prefix's postings costs their number; by Markov's inequality at most 1/l of that number of documents
    share l of them, and each costs VERIFY_COST and a share of the document's length."""
    most = min(MOST_MATCHES, len(counts) - base + 1)
    read = np.cumsum(counts)[base - 1 : base - 1 + most] - np.arange(base, base + most)
    cost = read + read / np.arange(1, most + 1) * (VERIFY_COST + len(counts) / 16)
    return int(np.argmin(cost)) + 1


def _prefixes(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = list_parts(batch.column("found"))
            df, h = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            n = batch.column("n").to_numpy()
            rows = []
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                base = int(n[i]) - needed(int(n[i]), num, den) + 1 - (int(n[i]) - int(b - a))
                if base < 1:
                    continue
                matches = choose_matches(df[a:b], base)
                rows.append((i, h[a:b], matches, base + matches - 1))
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("n").take(at), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=["key", "n", "tokens", "matches", "prefix"])

    return run


def _similar(task: pa.Table, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i similar to i) over a block's documents; with two sides, only pairs across them."""
    n, side = task.column("n").to_numpy(), task.column("side").to_numpy()
    matches, prefix = task.column("matches").to_numpy(), task.column("prefix").to_numpy()
    flat, offsets = list_parts(task.column("tokens").combine_chunks())
    _, token = np.unique(flat.to_numpy(), return_inverse=True)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), sizes)
    early = np.arange(len(token)) - np.repeat(offsets[:-1], sizes) < np.repeat(prefix, sizes)

    def postings(which: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, d = token[which], doc[which]
        order = np.argsort(t, kind="stable")
        count = np.bincount(t, minlength=token.max() + 1 if len(token) else 0)
        return d[order], np.cumsum(count) - count, count

    first, every = postings(early), postings(slice(None))
    two = side.max() > 0
    for i in range(len(n)):
        if two and side[i]:
            continue
        own = token[offsets[i] : offsets[i + 1]]
        met = np.bincount(ragged_take(first[0], first[1][own[: prefix[i]]], first[2][own[: prefix[i]]])[0], minlength=len(n))
        may = (met >= np.minimum(matches[i], matches)) & (den * n >= num * n[i]) & (den * n[i] >= num * n)
        may &= side > 0 if two else np.arange(len(n)) > i
        if may.any():
            shared = np.bincount(ragged_take(every[0], every[1][own], every[2][own])[0], minlength=len(n))
            yield i, np.flatnonzero(may & (den * shared >= num * (n[i] + n - shared)))


def _verify(num: int, den: int):
    """For each document with links in a block: the smallest key that the block's links connect it to, and how many
    documents it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in arrow_batches(batches, "task"):
            keys, copies = task.column("key").to_numpy(), task.column("copies").to_numpy()
            parent = list(range(len(keys)))

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            links = np.zeros(len(keys), np.int64)
            for i, found in _similar(task, num, den):
                links[i] += copies[found].sum()
                links[found] += copies[i]
                for j in found.tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b, key=keys.__getitem__)] = min(a, b, key=keys.__getitem__)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(keys[[root(i) for i in at]]), pa.array(links[at])], names=["key", "root", "links"])

    return run


def _keyed(docs: DataFrame, k: int) -> DataFrame:
    return map_arrow(docs, _signatures(k), "doc_id long, n long, key long")


def _known_few(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _linked_nodes(docs: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The different sets among rows (doc_id, n, key): key, low (smallest id), copies, component_id, n_links, first
    (whether it is the set of its component that has the smallest id)."""
    parts = shuffle_partitions(docs.sparkSession)
    nodes = materialize(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.max("n").alias("n")), "nodes")

    shingles = map_arrow(docs, _sampled(k), "h long, key long").repartition(parts, "h").sortWithinPartitions("h")
    packed = map_arrow(shingles, _lonely(parts), "bucket int, keys array<long>, counts array<int>")
    alone = map_arrow(packed.repartition(parts, "bucket"), _summed, "key long, alone long")
    free = F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}")
    out = materialize(alone.join(nodes.select("key", "n"), "key").where(F.col("alone") > free).select("key"), "unlike")
    left = materialize(nodes.join(out, "key", "left_anti"), "alike")

    # A set is read again from any row of its smallest id; sets that only rows without an id hold, from all such rows.
    wanted = docs.join(_known_few(left.select(F.col("low").alias("doc_id")).where("doc_id is not null").distinct()), "doc_id", "left_semi")
    if not left.where("low is null").isEmpty():
        wanted = wanted.unionByName(docs.where("doc_id is null"))
    sets = map_arrow(wanted, _tokens(k), "key long, tokens array<long>").dropDuplicates(["key"])
    sets = materialize(sets.join(left.select("key", "n"), "key"), "sets")
    each = sets.select("key", "n", F.explode("tokens").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    found = each.join(common, "h").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("found"))
    prefixed = materialize(map_arrow(found, _prefixes(num, den), "key long, n long, tokens array<long>, matches int, prefix int"), "prefixes")

    early = prefixed.select("key", F.explode(F.slice("tokens", 1, F.col("prefix"))).alias("h"))
    anchor = early.groupBy("h").agg(F.min("key").alias("anchor"), F.count("*").alias("df")).where("df > 1").select("h", "anchor")
    labels = connected_components(early.join(anchor, "h").select("key", "anchor").distinct(), "key", "anchor")
    placed = prefixed.join(labels.select(F.col("node").alias("key"), F.col("label").alias("family")), "key").join(nodes.select("key", "copies"), "key")
    placed = materialize(placed.withColumn("lead", F.xxhash64(F.col("tokens")[0])), "families")
    weight = F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.size("tokens")) / BLOCK_SHINGLES)
    # Each family has two members at least. Only the few large ones are dealt into cells; their sizes are broadcast, so
    # that no family is a hot key.
    large = materialize(placed.groupBy("family").agg(F.ceil(weight).cast("int").alias("spread")).where("spread > 1"), "large-families")
    placed = placed.join(_known_few(large), "family", "left").withColumn("bucket", F.expr("pmod(lead, spread)").cast("int"))
    buckets = materialize(placed.where("spread is not null").groupBy("family", "bucket").agg(F.ceil(weight).cast("int").alias("cells")).where("cells > 1"), "large-buckets")
    placed = placed.join(_known_few(buckets), ["family", "bucket"], "left").withColumn("cell", F.expr("bucket * 1000000L + pmod(xxhash64(key, 1), coalesce(cells, 1))"))
    placed = materialize(placed.select("family", "spread", "cell", "key", "n", "copies", "matches", "prefix", "tokens"), "placed")

    body = ["key", "n", "copies", "matches", "prefix", "tokens"]
    small = placed.where("spread is null").select(F.xxhash64("family").alias("task"), F.lit(0).alias("side"), *body)
    wide = placed.where("spread is not null")
    met = wide.select("family", "cell", F.explode(F.slice("tokens", 1, F.col("prefix"))).alias("h")).distinct()
    pairs = met.alias("x").join(met.alias("y"), ["family", "h"]).where("x.cell <= y.cell").select("family", F.col("x.cell").alias("one"), F.col("y.cell").alias("two")).distinct()
    pairs = materialize(pairs.withColumn("task", F.xxhash64("family", "one", "two")), "cells")
    sides = pairs.select("family", F.col("one").alias("cell"), "task", F.lit(0).alias("side")).unionByName(pairs.where("one <> two").select("family", F.col("two").alias("cell"), "task", F.lit(1).alias("side")))
    tasks = small.unionByName(wide.join(sides, ["family", "cell"]).select("task", "side", *body))
    dealt = tasks.repartition(parts, "task").sortWithinPartitions("task")
    links = materialize(map_arrow(dealt, _verify(num, den), "key long, root long, links long"), "links")

    label = connected_components(links, "key", "root").select(F.col("node").alias("key"), "label")
    known = nodes.join(label, "key")
    lows = known.groupBy("label").agg(F.min("low").alias("component_id"), F.min_by("key", F.struct(F.col("low").isNull(), "low", "key")).alias("head"))
    linked = known.join(lows, "label").select("key", "component_id", "head").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    final = nodes.join(linked, "key", "left").select("key", "low", "copies", F.coalesce("component_id", "low").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.coalesce("head", "key") == F.col("key")).alias("first"))
    return materialize(final, "final")


def jaccard_components(df: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id (smallest id that links reach, its own included) and
    n_links (other rows it is linked with). Two rows are linked if den * |x and y| >= num * |x or y| over their sets of
    distinct k-word shingles; rows without words have no links.

    1. Rows with one set are one node with a count of copies. 2. A node more than 1 - t of whose shingles nobody else has
    can't be linked; a quarter of all shingles shows that for most nodes. 3. The others' shingles get exact document
    frequencies, and each node its prefix. 4. Nodes are gathered along shared prefix shingles, dealt into blocks of
    bounded size, and each pair of blocks that shares a prefix shingle is compared once: candidates by prefix matches,
    then exact counts. A block returns a row for each node with links, not the pairs. 5. Components of these links.

    Sets hold 64-bit hashes. A null id has component null unless copies or links give it one; rows of a repeated id are
    judged by their own texts. Null texts are empty; other columns are ignored; an empty table gives no rows."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(_keyed(docs, k), "signatures")
    final = _linked_nodes(docs, rows, k, num, den).select("key", "component_id", "n_links", (F.col("copies") > HOT_COPIES).alias("hot"))
    # Sets with very many copies are few, so they meet their rows by broadcast and no task gets all the copies.
    hot, cold = final.where("hot").drop("hot"), final.where("not hot").drop("hot")
    full, bare = rows.where("key is not null"), rows.where("key is null")
    if hot.count() <= BROADCAST_IDS:
        joined = full.join(F.broadcast(hot), "key").unionByName(full.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key"))
    else:
        joined = full.join(final.drop("hot"), "key")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("n_links").cast("long").alias("n_links"))
    return out.unionByName(bare.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: the one with the smallest id, or any one of those without an id if none has
    one. Of rows that share id and set one stays. Rows without words (null, empty or blank texts) are linked with
    nothing and all stay. An empty table gives no rows; other columns are kept as they are.

    Where ids are unique, rows are dropped by id alone; only rows whose id is null or repeated are read again to know
    their sets."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(_keyed(docs, k), "signatures")
    final = _linked_nodes(docs, rows, k, num, den)
    dull = final.where("not first or copies > 1").select("key", "low", "first", (F.col("copies") > HOT_COPIES).alias("hot"))
    dull = materialize(dull, "dull")
    hot = dull.where("hot").drop("hot")
    few = hot.count() <= BROADCAST_IDS
    if few:
        met = rows.join(F.broadcast(hot), "key").unionByName(rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(dull.where("not hot").drop("hot"), "key"))
    else:
        met = rows.join(dull.drop("hot"), "key")
    gone = met.where("doc_id is not null and not (first and doc_id <=> low)").select("doc_id")
    odd = materialize(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    named = odd.select(F.col("doc_id").alias(id_col))
    if odd.isEmpty() and docs.where("doc_id is null").isEmpty():
        return without_ids(df, gone.select(F.col("doc_id").alias(id_col)), id_col)
    few_odd = _known_few(named)
    plain = without_ids(df.where(F.col(id_col).isNotNull()).join(few_odd, id_col, "left_anti").select(*df.columns), gone.select(F.col("doc_id").alias(id_col)), id_col)
    again = df.where(F.col(id_col).isNull()).unionByName(df.join(few_odd, id_col, "left_semi").select(*df.columns))
    names, spare = df.columns, f"_key_{len(df.columns)}"
    keyed = again.withColumn(spare, F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column(spare), "text"), "")
            keys = pa.array([_key(s) if len(s) else None for s in shingle_sets(texts, k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pc.struct_field(batch.column(spare), "doc_id"), keys], names=[*names, f"{spare}_id", f"{spare}_set"])

    kinds = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"{spare}_id long", f"{spare}_set long"])
    keyed = materialize(map_arrow(keyed, add_keys, kinds), "odd-rows")
    heads = final.where("first").select(F.col("key").alias(f"{spare}_set"), "low")
    bare = keyed.where(F.col(f"{spare}_set").isNull())
    kept = keyed.join(heads.withColumnRenamed("low", f"{spare}_low"), f"{spare}_set").where(F.col(f"{spare}_id").eqNullSafe(F.col(f"{spare}_low"))).dropDuplicates([f"{spare}_set"])
    return plain.unionByName(bare.select(*df.columns)).unionByName(kept.select(*df.columns))
