"""Approximate nearest neighbours by learned partitions: a neighbour graph of a sample is cut into balanced parts, a small
classifier learns the part of a vector from its neighbours' parts, and queries are routed to several most probable parts
for exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, materialize

#: Vectors from which the partitions are learned (smallest id hashes), neighbours of each in the graph, and the share of
#: true neighbours that the routing must reach on vectors of the sample that the classifier has not seen.
SAMPLE, NEIGHBOURS, TARGET = 6000, 10, 0.95
#: Vectors of the sample for each part at least; there are as many parts as the root of the number of vectors, if the
#: sample can tell them apart.
LEAST_IN_PART = 20
HIDDEN, EPOCHS = 96, 40
#: Candidates and queries of one block; a part with more is dealt into several blocks.
BLOCK, QUERY_BLOCK = 8192, 4096


class Router:
    """The classifier (one hidden layer), and how many parts a query visits at least."""

    def __init__(self, layers: list[np.ndarray], visits: int):
        self.layers, self.visits = layers, visits

    @property
    def parts(self) -> int:
        return self.layers[-1].shape[0]

    @property
    def size(self) -> int:
        return self.layers[0].shape[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        return np.maximum(x / np.where(norms > 0, norms, 1) @ w1 + b1, 0) @ w2 + b2


def neighbour_lists(x: np.ndarray, among: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places in `among` of the k largest inner products of each row of x; own: each row's own place, left out."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ among.T
        if own is not None:
            s[np.arange(len(s)), own[a : a + 1024]] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), 1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each vertex so that few edges are cut and no part is over 5 % above its share.

    Starts from means with bounded sizes; then vertices move to the part that holds most of their neighbours, those that
    gain most first, as far as there is room."""
    n, room = len(x), math.ceil(len(x) / parts * 1.05)
    rng = np.random.default_rng(11)
    centres = x[rng.choice(n, parts, replace=False)].copy()
    part = np.zeros(n, np.int64)
    for _ in range(6):
        gain = x @ centres.T
        left = np.full(parts, room)
        for i in np.argsort(-gain.max(1), kind="stable"):
            for p in np.argsort(-gain[i], kind="stable"):
                if left[p]:
                    part[i], left[p] = p, left[p] - 1
                    break
        centres = np.array([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
    k = graph.shape[1]
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    starts = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    for _ in range(rounds):
        votes = np.bincount(starts * parts + part[ends], minlength=n * parts).reshape(n, parts)
        wish = votes.argmax(1)
        gains = votes[np.arange(n), wish] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gains, kind="stable")[: int((gains > 0).sum())]:
            if rng.random() < 0.5 and size[wish[i]] < room:
                size[wish[i]] += 1
                size[part[i]] -= 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


def fit(x: np.ndarray, parts: int, k_search: int = 20) -> Router:
    """The router from distinct vectors."""
    n = len(x)
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    unit = x / np.where(norms > 0, norms, 1)
    if parts < 2:
        return Router([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    graph = neighbour_lists(x, x, min(NEIGHBOURS, n - 1), np.arange(n))
    part = balanced_parts(unit, graph, parts)
    near = np.zeros((n, parts))
    np.add.at(near, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    wanted = 0.5 * np.eye(parts)[part] + 0.5 * near / graph.shape[1]
    rng = np.random.default_rng(3)
    unseen = rng.random(n) < 0.15
    seen = np.flatnonzero(~unseen)
    layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        rng.shuffle(seen)
        for a in range(0, len(seen), 128):
            at = seen[a : a + 128]
            h = np.maximum(unit[at] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - wanted[at]) / len(at)
            back = (d @ layers[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((unit[at].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] -= 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(layers, parts)
    at = np.flatnonzero(unseen)
    if len(at):
        true = neighbour_lists(x[at], x, min(k_search, n - 1), at)
        scores = router.scores(x)
        assigned = scores.argmax(1)
        place = np.argsort(np.argsort(-scores[at], 1, kind="stable"), 1)
        rank = np.take_along_axis(place, assigned[true], 1)
        reached = [(rank < m).mean() for m in range(1, parts + 1)]
        router.visits = next((m for m, r in enumerate(reached, 1) if r >= TARGET), parts)
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def search(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`, its k nearest found (largest inner product) among all other rows:
    query_id, rank (from 1), vec_id, score (double precision, on the original vectors), nearest first, ties to the
    smaller vec_id; all candidates if fewer.

    The index holds every row: each is put into its most probable part. A query visits its most probable parts: as many
    as reach TARGET on the sample, and on until these hold 2 * (k + 1) rows; it scores the rows of these parts only.
    Parts with many rows or queries are dealt into blocks of bounded size by hashes of the ids; a block scores its
    queries against its candidates and returns k of each query, from which the k best are taken. Equal vectors in a
    block stand as one with their k + 1 smallest ids, which loses nothing.

    Rows take no part whose id or vector is null or empty, or whose vector is zero or holds a null or non-finite
    component. Shorter vectors stand as if zeros followed. Rows of a query's own id are not its candidates; of several
    rows of one query id, the one with the smallest vector asks. Other columns are ignored; an empty table gives no
    rows."""
    spark = df.sparkSession
    # A third state for null components: forall() is null with them, and so is the whole condition.
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))
    out = "query_id long, rank int, vec_id long, score double"
    total, size, least = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], out)
    if least < size:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))))
    sample = np.unique(np.array([r["v"] for r in hash_sample(rows, SAMPLE, total, "vec_id").select("v").collect()]).reshape(-1, size), axis=0)
    parts = max(1, min(round(math.sqrt(total)), len(sample) // LEAST_IN_PART))
    router = fit(sample, parts, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.scores(_matrix(batch.column("v"))).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    index = materialize(map_arrow(rows, assign, "vec_id long, v array<double>, part int"), "ann-index")
    held = np.zeros(router.parts, np.int64)
    for r in index.groupBy("part").count().collect():
        held[r["part"]] = r["count"]
    asking = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best = np.argsort(-router.scores(_matrix(batch.column("v"))), 1, kind="stable")
            before = np.cumsum(held[best], 1) - held[best]
            visit = ((np.arange(router.parts) < router.visits) | (before < 2 * (k + 1))) & (held[best] > 0)
            at, place = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(best[at, place].astype(np.int32))], names=["query_id", "part"])

    asking = materialize(asking, "ann-queries")
    routed = materialize(map_arrow(asking, route, "query_id long, part int"), "ann-routes")
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = spark.createDataFrame([(p, math.ceil(held[p] / BLOCK), math.ceil(n / QUERY_BLOCK)) for p, n in asked.items()] or [], "part int, blocks int, asks int")
    blocks = F.broadcast(blocks)  # as many rows as there are parts: SAMPLE / LEAST_IN_PART at most
    candidates = index.join(blocks, "part").select("part", "vec_id", "v", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)").alias("block"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"))
    queries = routed.join(asking.select(F.col("vec_id").alias("query_id"), "v"), "query_id").join(blocks, "part")
    queries = queries.select("part", "query_id", "v", F.expr("cast(pmod(xxhash64(query_id), asks) as int)").alias("ask"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def nearest(asks: pa.Table, those: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asks.num_rows or not those.num_rows:
            return empty
        ids, c = those.column("vec_id").to_numpy(), _matrix(those.column("v").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], c[order]
        _, first, same = np.unique(np.ascontiguousarray(c + 0.0).view(f"V{c.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(same, kind="stable")  # by vector, then by id
        begins = np.searchsorted(same[order], np.arange(len(first)))
        ends = np.minimum(np.append(begins[1:], len(order)), begins + k + 1)
        distinct = c[first]
        query_ids, q = asks.column("query_id").to_numpy(), _matrix(asks.column("v").combine_chunks())
        parts = []
        for a in range(0, len(q), 256):
            s = q[a : a + 256] @ distinct.T
            most = min(k + 1, s.shape[1])
            least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
            i, j = np.nonzero(s >= least[:, None] - 1e-9 * np.maximum(1, np.abs(least))[:, None])
            score = np.einsum("ij,ij->i", q[a + i], distinct[j])
            n = ends[j] - begins[j]
            at = np.repeat(begins[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            asker, found, score = np.repeat(query_ids[a + i], n), ids[order[at]], np.repeat(score, n)
            keep = asker != found
            asker, found, score = asker[keep], found[keep], score[keep]
            by = np.lexsort((found, -score, asker))
            asker, found, score = asker[by], found[by], score[by]
            starts = np.flatnonzero(np.append(True, asker[1:] != asker[:-1])) if len(asker) else np.zeros(0, np.int64)
            place = np.arange(len(asker)) - np.repeat(starts, np.diff(np.append(starts, len(asker))))
            parts.append((asker[place < k], found[place < k], score[place < k]))
        asker, found, score = map(np.concatenate, zip(*parts))
        return pa.table({"query_id": asker, "vec_id": found, "score": score})

    keys = ["part", "block", "ask"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
