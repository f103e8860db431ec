"""SimHash near-duplicates: 64-bit fingerprints of texts, joined at few differing bits by vantage-point trees.

Two fingerprints of at most 3 differing bits differ in at most one bit of one of their halves. So there is a tree for each
half, over the Hamming distance of that half, and it is asked for distance 1. A node has a vantage point and a radius; by
the triangle bound a fingerprint whose distance to the vantage point is d has its partners within 1 on the inner side only
if d - 1 <= radius, and on the outer side only if d + 1 > radius. The leaves of a tree made of a sample are the shards:
each fingerprint is a member of one, and asks in all whose region its ball overlaps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, hash_sample, map_arrow, materialize, shuffle_partitions, text_chunks, texts_of
from .components import connected_components

BITS, SEED, WORDS = 3, 42, 3
#: Fingerprints that the trees are made of at most (8 bytes each go to the driver), and how many of them a leaf has at least.
SAMPLE, LEAST_IN_LEAF = 1 << 16, 16
#: Members that a shard should have; members and askers that one task compares at a time.
MEMBERS, MOST_MEMBERS, MOST_ASKERS = 1024, 1 << 20, 1 << 13
#: Pairs of fingerprints that are compared at once, and below how many there is no further split.
PAIRS_AT_ONCE, DIRECT = 1 << 20, 1 << 15
#: A fingerprint is hot if more than one in HOT rows has it; so there are no more than HOT hot ones.
HOT = 10_000
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- fingerprints


def _majority(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes of each row have each bit (rows x 64, the lowest bit first), and how many hashes a row has."""
    counts, total = np.zeros((rows, 64), np.int64), np.bincount(row, minlength=rows)
    for at in range(0, len(hashes), 1 << 16):
        own = row[at : at + (1 << 16)]
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return counts, total


def fingerprints_of(texts: pa.Array, k: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text as an unsigned number; zero for texts without words."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets, rows = offsets - offsets[0], len(texts)
    if not len(data):
        return np.zeros(rows, np.uint64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a document ends at these places, and the next one begins
    edge[offsets] = True
    before, after = np.r_[True, space[:-1]] | edge[:-1], np.r_[space[1:], True] | edge[1:]
    starts, stops = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if not len(starts):
        return np.zeros(rows, np.uint64)
    # One blank for each run of white space behind a word.
    lengths, blank = stops - starts, np.zeros(len(data), bool)
    blank[1:] = space[1:] & ~space[:-1]
    widths = lengths + np.append(space, False)[stops]
    new_starts = np.cumsum(widths) - widths
    data[space] = 0x20
    body = data[~space | blank].tobytes()
    row = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    many = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
    of = np.arange(rows).repeat(many)
    head = np.arange(len(of)) - (np.cumsum(many) - many)[of] + first[of]
    tail = np.minimum(head + k - 1, (first + count - 1)[of])
    hashes = np.empty(len(of), np.uint64)
    for at in range(0, len(of), 1 << 16):
        some = slice(at, at + (1 << 16))
        cuts = zip(new_starts[head[some]].tolist(), (new_starts[tail[some]] + lengths[tail[some]]).tolist())
        hashes[some] = list(map(xxhash.xxh64_intdigest, (body[a:b] for a, b in cuts), repeat(seed)))
    ones, total = _majority(hashes, of, rows)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(df: DataFrame, k: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed number) for each row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(texts_of(batch), k, seed).view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs, run, "doc_id long, fp long")


# --- vantage-point trees


def distance(a: np.ndarray, b: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def vantage(points: np.ndarray, mask: np.uint64, reach: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point, among some of the points, and the radius that part them best: both sides well filled, and few
    points so near the border that they ask on both. None where no split would pay."""
    best, worth = None, 0.05
    sample = points if len(points) <= 2048 else points[:: len(points) // 2048]
    for v in sample[:: max(1, len(sample) // tries)][:tries]:
        share = np.bincount(distance(sample, v, mask), minlength=65) / len(sample)
        inner = np.cumsum(share)
        asks_in = np.append(inner[reach:], np.ones(reach))  # d - reach <= radius
        asks_out = 1 - np.append(np.zeros(reach), inner)[:65]  # d + reach > radius
        saved = 1 - inner * asks_in - (1 - inner) * asks_out  # of the comparisons of all with all
        r = int(np.argmax(saved))
        if saved[r] > worth:
            best, worth = (v, r), saved[r]
    return best


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree over one half: node i has a point, a radius and two children; a child below zero is the leaf
    of the number -1 - child."""

    mask: np.uint64
    points: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    leaves: int

    @classmethod
    def grow(cls, sample: np.ndarray, mask: np.uint64, least: int, reach: int = 1) -> Tree:
        points, radii, children, leaves = [], [], [], 0
        work = [(np.arange(len(sample)), -1, 0)]
        while work:
            own, parent, side = work.pop()
            split = vantage(sample[own], mask, reach) if len(own) >= 2 * least else None
            inside = distance(sample[own], split[0], mask) <= split[1] if split else None
            if split is None or min(inside.sum(), (~inside).sum()) < least:
                leaves, number = leaves + 1, -1 - leaves
            else:
                number = len(points)
                points.append(split[0]), radii.append(split[1]), children.append([0, 0])
                work += [(own[inside], number, 0), (own[~inside], number, 1)]
            if parent >= 0:
                children[parent][side] = number
        return cls(mask, np.array(points, np.uint64), np.array(radii, np.int64), np.array(children, np.int64).reshape(-1, 2), leaves)

    def route(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Which fingerprints come to which leaves: their places, and the leaves. With reach 0 each comes to its own."""
        at, leaf, work = [], [], [(0 if len(self.points) else -1, np.arange(len(fps)))]
        while work:
            node, own = work.pop()
            if not len(own):
                continue
            if node < 0:
                at.append(own), leaf.append(np.full(len(own), -1 - node))
                continue
            d = distance(fps[own], self.points[node], self.mask).astype(np.int64)
            work += [(self.children[node, 0], own[d - reach <= self.radii[node]]), (self.children[node, 1], own[d + reach > self.radii[node]])]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *at]), np.concatenate([none, *leaf])


class Links:
    """Links among numbered nodes, kept as a forest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[nodes]
            if (up == nodes).all():
                return nodes
            nodes = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the ends of all links: each larger root hangs below the smallest root that it met, until none differ."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            left = low != high
            a, b = low[left], high[left]
            np.minimum.at(self.parent, b, a)


def near_pairs(members: np.ndarray, askers: np.ndarray, bits: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (member, asker) of fingerprints at `bits` or fewer differing bits that differ by one at most in the half: a
    tree is grown over the members as it is asked. Where the half tells no more, the other one goes on with all bits."""
    work = [(np.arange(len(members)), np.arange(len(askers)), 1)]
    while work:
        m, a, reach = work.pop()
        if not len(m) or not len(a):
            continue
        mask = HALVES[half] if reach == 1 else HALVES[1 - half]
        split = vantage(members[m], mask, reach) if len(m) * len(a) > DIRECT else None
        if split:
            d, e = distance(members[m], split[0], mask).astype(np.int64), distance(askers[a], split[0], mask).astype(np.int64)
            work += [(m[d <= split[1]], a[e - reach <= split[1]], reach), (m[d > split[1]], a[e + reach > split[1]], reach)]
        elif reach == 1 and len(m) * len(a) > DIRECT:
            work.append((m, a, bits))
        else:
            step = max(1, PAIRS_AT_ONCE // len(m))
            for at in range(0, len(a), step):
                asked = a[at : at + step]
                x, y = np.nonzero(np.bitwise_count(members[m][:, None] ^ askers[asked][None, :]) <= bits)
                yield m[x], asked[y]


def _route(trees: list[Tree]):
    """Rows (shard, fp, member): each fingerprint in all shards in which it asks, and marked where it is a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(every), 1 << 14):
                fps, base = every[at : at + (1 << 14)], 0
                for tree in trees:
                    place, leaf = tree.route(fps, 1)
                    home = np.zeros(len(fps), np.int64)
                    own, own_leaf = tree.route(fps, 0)
                    home[own] = own_leaf
                    yield pa.RecordBatch.from_arrays([pa.array((leaf + base).astype(np.int32)), pa.array(fps[place].view(np.int64)), pa.array(home[place] == leaf)], names=["shard", "fp", "member"])
                    base += tree.leaves

    return run


def _compare(bits: int, first_leaves: int):
    """The forests of the links of each task: rows (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_batches(batches, "task"):
            fps = rows.column("fp").to_numpy().view(np.uint64)
            member, asks = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("member", "asks"))
            names, number = np.unique(fps, return_inverse=True)
            half = int(rows.column("shard")[0].as_py() >= first_leaves)
            members, askers = np.unique(number[member]), np.unique(number[asks])
            links = Links(len(names))
            for x, y in near_pairs(names[members], names[askers], bits, half):
                links.add(members[x], askers[y])
            above = links.roots(np.arange(len(names)))
            linked = np.flatnonzero(above != np.arange(len(names)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(names[above[linked]].view(np.int64)), pa.array(names[linked].view(np.int64))], names=["a", "b"])

    return run


def near_links(fps: DataFrame, total: int, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, no repeats; `total` rows) that connect those that chains of
    links at `bits` or fewer differing bits connect. Not every link is a row: of each task a forest.

    The tree is made of a sample of SAMPLE fingerprints at most; every fingerprint is dealt by it. Shards are dealt into
    tasks of bounded members and askers, by their sizes (a row for each of the SAMPLE / LEAST_IN_LEAF leaves at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("each half is asked for distance 1, which holds for up to 3 bits")
    spark, parts = fps.sparkSession, shuffle_partitions(fps.sparkSession)
    drawn = hash_sample(fps.select("fp"), SAMPLE, total, "fp").select("fp").toArrow().column("fp").to_numpy()
    sample = np.sort(drawn).view(np.uint64)
    np.random.default_rng(SEED).shuffle(sample)
    least = max(LEAST_IN_LEAF, MEMBERS * len(sample) // max(1, total))
    trees = [Tree.grow(sample, mask, least) for mask in HALVES]
    routed = materialize(map_arrow(fps.select("fp"), _route(trees), "shard int, fp long, member boolean"), "routed")
    sizes = routed.groupBy("shard").agg(F.count_if("member").alias("members"), F.count("*").alias("askers"))
    blocks = sizes.select("shard", F.greatest(F.ceil(F.col("members") / MOST_MEMBERS), F.lit(1)).cast("int").alias("wide"), F.ceil(F.col("askers") / F.greatest(F.lit(MOST_ASKERS), 4 * F.least(F.col("members"), F.lit(MOST_MEMBERS)))).cast("int").alias("high"))
    placed = routed.join(F.broadcast(blocks), "shard")  # no more rows than leaves
    wide, high = F.expr("cast(pmod(xxhash64(fp), wide) as int)"), F.expr("cast(pmod(xxhash64(fp, 7), high) as int)")
    # A task is a block of members against a block of askers. Members come to all blocks of askers, askers to all of members.
    asked = placed.select("shard", "fp", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("i"), high.alias("j"), F.lit(False).alias("member"), F.lit(True).alias("asks"))
    held = placed.where("member").select("shard", "fp", wide.alias("i"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("j"), F.lit(True).alias("member"), F.lit(False).alias("asks"))
    dealt = asked.unionByName(held).select(F.xxhash64("shard", "i", "j").alias("task"), "shard", "fp", "member", "asks")
    return map_arrow(dealt.repartition(parts, "task").sortWithinPartitions("task"), _compare(bits, trees[0].leaves), "a long, b long")


# --- documents


def near_duplicates(df: DataFrame, bits: int = BITS, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach, its own included).

    A-Z are lower-cased; shingles of k words count as often as they occur. Texts without words (null, empty, blank) have
    fingerprint zero, and are linked like any other. A null id has component null unless its component has an id; rows
    of a repeated id are judged by their own texts. Other columns are ignored; an empty table gives no rows.

    Copies are one fingerprint, so groups of copies cost a count; those with very many rows meet them by broadcast."""
    rows = materialize(fingerprints(df, k, SEED, id_col, text_col), "fingerprints")
    known = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "distinct")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    links = materialize(near_links(known, size["n"], bits), "links")
    labels = connected_components(links).select(F.col("node").alias("fp"), "label")
    linked = known.join(labels, "fp")
    lows = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    placed = known.join(linked.select("fp", "label").join(lows, "label").select("fp", "component_id"), "fp", "left")
    placed = materialize(placed.select("fp", F.coalesce("component_id", "low").alias("component_id"), (F.col("copies") * HOT > size["rows"]).alias("hot")), "components")
    hot = F.broadcast(placed.where("hot").drop("hot"))  # HOT rows at most
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(placed.where("not hot").drop("hot"), "fp")
    out = rows.join(hot, "fp").unionByName(cold)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
