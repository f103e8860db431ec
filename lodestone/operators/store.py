"""Storage and incremental maintenance: upserts, producer ingests, subtree patches, deltas, signatures, versioned tables."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import aux_tokens
from ..schema import CHUNKS, FACT, INTENT, INTENT_KINDS, KEYS, TABLES, validate
from .graph import subtree
from .lineage import settle
from .search import Index, chunk_signature

VERSION, HISTORY = 6, 20
#: Tries of a write that meets other writers, and seconds of waiting before the second.
TRIES, WAIT = 5, 0.2
#: A segment of the text index is merged with the next newer one unless it has more than so many times its chunks.
SEGMENT_RATIO = 4
STORED = ("entities", "edges", "chunks")
#: The column that ties a row of a table to an entity's subtree.
OWNER = {"entities": "id", "edges": "src", "chunks": "entity_id"}


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row of each key: the one with the highest `by`; equal ones are ordered by all columns."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in (*keys, by)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), *rest))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same key; ownership moves to the new row. Of new's rows of one key the
    last written wins: the one with the highest `seq`, where new has that column (extracts number their rows); rows
    without a number are ordered by all their columns."""
    if "seq" in new.columns:
        once = latest(new, keys, "seq").drop("seq")
    else:
        once = latest(new.withColumn("_none", F.lit(0)), keys, "_none").drop("_none")
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once)


@dataclass(frozen=True)
class Snapshot:
    """The tables of an index."""

    entities: DataFrame
    edges: DataFrame
    chunks: DataFrame

    def without_producer(self, producer: str) -> Snapshot:
        other = lambda df: df.where(~F.col("producer").eqNullSafe(F.lit(producer)))
        return Snapshot(other(self.entities), other(self.edges), other(self.chunks))

    def upsert(self, delta: Snapshot) -> Snapshot:
        return Snapshot(*(upsert(getattr(self, t), getattr(delta, t), KEYS[t]) for t in ("entities", "edges", "chunks")))

    def owned_by(self, producer: str) -> Snapshot:
        own = lambda df: df.withColumn("producer", F.lit(producer))
        return Snapshot(own(self.entities), own(self.edges), own(self.chunks))


def ingest_producer(state: Snapshot, producer: str, delta: Snapshot) -> Snapshot:
    """The producer's rows replaced by delta, which may be empty."""
    return state.without_producer(producer).upsert(delta.owned_by(producer))


def default_roots(delta: Snapshot) -> DataFrame:
    return delta.entities.where("parent is null").select("id")


def patch(state: Snapshot, delta: Snapshot, producer: str, roots: DataFrame | None = None) -> Snapshot:
    """Subtrees of the roots (default: delta's entities without parent) replaced by delta: their entities, chunks and
    outgoing edges go whoever owns them; edges into them stay."""
    gone = subtree(state.entities, default_roots(delta) if roots is None else roots)
    kept = Snapshot(
        state.entities.join(gone, "id", "left_anti"),
        state.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").select(*state.edges.columns),
        state.chunks.join(gone.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(*state.chunks.columns),
    )
    return kept.upsert(delta.owned_by(producer))


def patch_scoped(state: Snapshot, delta: Snapshot, producer: str, roots: DataFrame | None = None) -> Snapshot:
    """As patch(), but only the producer's own rows go."""
    own = F.col("producer").eqNullSafe(F.lit(producer))
    gone = subtree(state.entities, default_roots(delta) if roots is None else roots)
    # One join of all rows, not a union of the producer's rows with the others: upsert() joins on where this leaves them.
    drop = lambda df, key: df.join(gone.select(F.col("id").alias("_gone")), (F.col(key) == F.col("_gone")) & own, "left_anti")
    kept = Snapshot(drop(state.entities, "id"), drop(state.edges, "src"), drop(state.chunks, "entity_id"))
    return kept.upsert(delta.owned_by(producer))


def apply_extract(state: Snapshot, producer: str, delta: Snapshot, mode: str = "full", roots: DataFrame | None = None) -> Snapshot:
    """A full extract replaces the producer's rows, a delta patches them; a delta with nothing in it does nothing."""
    if mode != "delta":
        return ingest_producer(state, producer, delta)
    if roots is None and delta.entities.isEmpty() and delta.edges.isEmpty() and delta.chunks.isEmpty():
        return state
    return patch_scoped(state, delta, producer, roots)


def owners(state: Snapshot, delta: Snapshot, gone: DataFrame | None) -> set[str | None]:
    """The producers of state's rows that delta's keys replace, or that belong to the ids `gone`."""
    out: set[str | None] = set()
    for t in ("entities", "edges", "chunks"):
        old = getattr(state, t)
        hit = old.join(getattr(delta, t).select(*KEYS[t]), KEYS[t], "left_semi").select("producer")
        if gone is not None:
            hit = hit.unionByName(old.join(gone.select(F.col("id").alias(OWNER[t])), OWNER[t], "left_semi").select("producer"))
        out |= {r[0] for r in hit.distinct().collect()}
    return out


def diff_signatures(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change (added, removed, changed, same) of tables (id, sig); an empty or null signature is always changed."""
    both = old.select("id", F.col("sig").alias("old"), F.lit(True).alias("had")).join(new.select("id", F.col("sig").alias("new"), F.lit(True).alias("has")), "id", "full_outer")
    same = (F.col("old") == F.col("new")) & (F.col("new") != "")
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select("id", change.alias("change"))


def fingerprint(files: DataFrame, buckets: int = 1) -> DataFrame:
    """One row: md5 of the sorted lines path|size|mtime. The manifest is one text; with buckets > 1 it is the md5 of the
    buckets' md5s, so that no task holds all lines."""
    line = F.concat_ws("|", F.col("path"), F.col("size").cast("string"), F.col("mtime").cast("string"))
    digest = lambda c: F.md5(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"))
    if buckets == 1:
        return files.agg(digest(line).alias("fingerprint"))
    return files.groupBy(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket")).agg(digest(line).alias("d")).agg(digest(F.concat_ws(":", F.col("bucket").cast("string"), F.col("d"))).alias("fingerprint"))


def keep_newest(history: DataFrame, by: str, most: int = HISTORY, partition: str | None = None) -> DataFrame:
    """The newest rows of a history, overall or of each partition."""
    if partition is None:
        return history.orderBy(F.desc(by), *[c for c in history.columns if c != by]).limit(most)
    place = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(by), *[c for c in history.columns if c not in (by, partition)]))
    return history.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


class Conflict(RuntimeError):
    """Another writer was first."""


#: What turns the tables of an older version into those of the next: (version, step). Versions 4 and 5 differ in the text
#: index only, which is made anew from the chunks.
MIGRATIONS = (
    (1, lambda s: replace(s, **{t: validate(getattr(s, t), t) for t in STORED})),  # rows had no producer
    (2, lambda s: replace(s, entities=s.entities.withColumn("authority", F.coalesce("authority", F.when(F.col("kind").isin(*INTENT_KINDS), INTENT).otherwise(FACT))))),
    (3, lambda s: replace(s, chunks=s.chunks.withColumn("aux", F.coalesce("aux", aux_tokens(F.col("entity_id"), F.col("text")))))),
    (4, lambda s: s),
    (5, lambda s: s),
)


class Store:
    """A versioned index in a folder of any Hadoop file system.

    A write makes new folders of Parquet tables for the producers that it touches and then a pointer `current-<n>`, which
    names the folders of all producers and comes into being as a whole or not at all. The highest n is current: there is
    always one, and readers keep the version that they opened. Of two writers that started from one version the second
    gets a Conflict; ingest() then applies its extract to the newer version. Each new store has its own generation, which
    voids signatures of older ones.

    The text index is a list of segments. A write indexes the chunks that it adds or changes as one new segment and names
    those that it replaces or removes as dead in older segments; small segments are merged."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str = "") -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.path}/{folder}" if folder else self.path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removeprefix("current-")) for n in self._names() if re.fullmatch("current-[0-9]+", n))

    def _meta_of(self, n: int) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/current-{n:012d}"))
        try:
            return {**json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()), "number": n}
        finally:
            stream.close()

    def meta(self) -> dict:
        """What the current pointer holds, with its number; empty where there is none."""
        numbers = self._versions()
        return self._meta_of(numbers[-1]) if numbers else {}

    def _name(self, meta: dict, number: int) -> None:
        """Creates the pointer of a version, whole and only if there is none: by a hard link on local disks, by a
        conditional create on object stores (what is written appears when it is closed), by a rename elsewhere, which
        HDFS refuses where the name is taken."""
        fs, path = self._fs()
        jvm, at = self.spark._jvm, path(f"{self.path}/current-{number:012d}")
        body, scheme = bytearray(json.dumps({k: v for k, v in meta.items() if k != "number"}).encode()), fs.getUri().getScheme()
        taken = Conflict(f"version {number} of {self.path} was written by another")
        if scheme in ("s3a", "gs", "abfs", "abfss"):
            try:
                stream = fs.createFile(at).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", True).build()
                stream.write(body)
                stream.close()
            except Py4JJavaError as error:
                raise taken from error
            return
        fresh = path(f"{self.path}/new-{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        stream.write(body)
        stream.close()
        try:
            if scheme == "file":
                local = lambda p: jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(at), local(fresh))
            elif fs.exists(at) or not fs.rename(fresh, at):
                raise taken
        except Py4JJavaError as error:
            raise taken from error
        finally:
            fs.delete(fresh, False)

    def create(self) -> Snapshot:
        """An empty index of a new generation, where there is none; the current one otherwise, brought to this version."""
        if not self._versions():
            self._name({"version": VERSION, "tables": {t: {} for t in STORED}, "segments": [], "dead": [], "generation": uuid.uuid4().hex}, 1)
        self.upgrade()
        return self.open()

    def _read(self, meta: dict, t: str, only: set[str | None] | None = None) -> DataFrame:
        held = meta["tables"][t]
        folders = held.values() if only is None or "*" in held else [f for p, f in held.items() if json.loads(p) in only]
        parts = [self.spark.read.schema(TABLES[t]).parquet(f"{self.path}/{folder}") for folder in sorted(set(folders))]
        return validate(union_all(parts) if parts else self.spark.createDataFrame([], TABLES[t]), t)

    def open(self) -> Snapshot:
        """The current tables. Nothing is written: a missing index, or one of a later version, is an error; the tables of
        an earlier version are read as those of this one."""
        return self.at(self.meta())

    def at(self, meta: dict) -> Snapshot:
        """The tables of the version that meta describes."""
        if not meta:
            raise FileNotFoundError(f"no index in {self.path}: build it first")
        version = int(meta.get("version", 0))
        if not 1 <= version <= VERSION:
            raise ValueError(f"the index in {self.path} is of version {version}; this library knows 1 to {VERSION}")
        state = Snapshot(*(self._read(meta, t) for t in STORED))
        for old, step in MIGRATIONS:
            state = step(state) if version <= old else state
        return state

    def upgrade(self) -> bool:
        """Writes an index of an earlier version as one of this; whether there was anything to do. Its generation stays,
        since the rows do."""
        base = self.meta()
        if not base or int(base["version"]) == VERSION:
            return False
        self.write(self.at(base), None, {**base, "segments": [], "dead": []})
        return True

    # --- the text index

    def index(self) -> Index:
        """The stemmed text index of the current chunks; made in memory where an old version has none that can be read."""
        meta = self.meta()
        if int(meta.get("version", 0)) < VERSION or not meta.get("segments"):
            return Index.build(self.at(meta).chunks, stemmed=True)
        return self._index(meta)

    def _segment(self, meta: dict, segment: dict) -> Index:
        index = Index.load(self.spark, f"{self.path}/{segment['name']}", stemmed=True)
        mine = [d["name"] for d in meta["dead"] if segment["name"] in d["of"]]
        if not mine:
            return index
        dead = union_all([self.spark.read.schema("segment string, chunk_id string").parquet(f"{self.path}/{d}") for d in mine])
        return index.without(dead.where(F.col("segment") == segment["name"]).select("chunk_id"))

    def _index(self, meta: dict) -> Index:
        return Index.union([self._segment(meta, s) for s in meta["segments"]])

    def _add_segment(self, index: Index, count: int) -> dict:
        name = f"seg-{uuid.uuid4().hex}"
        index.save(f"{self.path}/{name}")
        return {"name": name, "chunks": count}

    def _indexed(self, base: dict, before: DataFrame, after: DataFrame) -> dict:
        """segments and dead of the version that has the chunks `after` where `base` has `before` (both of the touched
        producers only): what is new or changed is one segment more; what is gone or changed is dead where it lies."""
        segments, dead = list(base.get("segments", [])), list(base.get("dead", []))
        new = after.select(F.col("id").alias("chunk_id"), chunk_signature().alias("new"))
        if segments:
            named = union_all([self._segment(base, s).lengths.select("chunk_id", "sig", F.lit(s["name"]).alias("segment")) for s in segments])
            held = named.join(before.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
            both = settle(held.join(new, "chunk_id", "full_outer").where("not (sig <=> new)"))
            gone = both.where("sig is not null").select("segment", "chunk_id")
            counts = {r["segment"]: r["count"] for r in gone.groupBy("segment").count().collect()}  # a row for each segment
            if counts:
                name = f"dead-{uuid.uuid4().hex}"
                gone.write.parquet(f"{self.path}/{name}")
                dead.append({"name": name, "of": sorted(counts)})
                segments = [{**s, "chunks": s["chunks"] - counts.get(s["name"], 0)} for s in segments]
            changed = after.join(both.where("new is not null").select(F.col("chunk_id").alias("id")), "id", "left_semi").select(*after.columns)
        else:
            changed = after
        count = changed.count()
        if count:
            segments.append(self._add_segment(Index.build(changed, stemmed=True), count))
        return self._merged({**base, "segments": segments, "dead": dead})

    def _merged(self, meta: dict) -> dict:
        """segments and dead after merging the newest segments while the next older one isn't far larger: a change costs
        a small segment, and there are few segments. Merging joins stored postings; no text is read."""
        segments = [s for s in meta["segments"] if s["chunks"] > 0]
        while len(segments) > 1 and segments[-2]["chunks"] <= SEGMENT_RATIO * segments[-1]["chunks"]:
            pair = segments[-2:]
            whole = Index.union([self._segment(meta, s) for s in pair])
            segments[-2:] = [self._add_segment(whole, sum(s["chunks"] for s in pair))]
        names = {s["name"] for s in segments}
        dead = [{**d, "of": [n for n in d["of"] if n in names]} for d in meta["dead"]]
        return {"segments": segments, "dead": [d for d in dead if d["of"]]}

    def heal(self) -> bool:
        """Makes the text index anew where a part of it is gone, or it doesn't have as many chunks as there are; whether it
        was so. Only names and footers are read for it; doctor() compares the contents."""
        base = self.meta()
        there = set(self._names())
        named = [x["name"] for x in (*base.get("segments", []), *base.get("dead", []))]
        chunks = self.at(base).chunks
        if all(n in there for n in named) and sum(s["chunks"] for s in base.get("segments", [])) == chunks.count():
            return False
        empty = {**base, "segments": [], "dead": []}
        self._name({**base, **self._indexed(empty, chunks.limit(0), chunks)}, base["number"] + 1)
        return True

    # --- writing

    def write(self, state: Snapshot, touched: set[str | None] | None = None, base: dict | None = None, **meta: str) -> Snapshot:
        """state as the next version. With `touched`, only these producers' rows are written, in one job a table; other
        producers keep the folders that the version `base` (default: the current one) names for them."""
        base = self.meta() if base is None else base
        tables: dict[str, dict[str, str]] = {}
        home = f"v-{uuid.uuid4().hex}"
        for t in STORED:
            rows, known, folder = validate(getattr(state, t), t), base.get("tables", {}).get(t, {}), f"{home}/{t}"
            if touched is None:
                rows.write.parquet(f"{self.path}/{folder}")
                tables[t] = {"*": folder}
                continue
            if "*" in known:  # written whole before: all producers are parted once
                names = sorted({r[0] for r in rows.select("producer").distinct().collect()} | touched, key=str)
                kept, mine = {}, rows
            else:
                names = sorted(touched, key=str)
                kept = {p: f for p, f in known.items() if json.loads(p) not in touched}
                mine = rows.where(reduce(lambda a, b: a | b, [F.col("producer").eqNullSafe(F.lit(p)) for p in names], F.lit(False)))
            part = reduce(lambda c, i: F.when(F.col("producer").eqNullSafe(F.lit(names[i])), i).otherwise(c), range(len(names)), F.lit(-1))
            mine.withColumn("part", part).write.partitionBy("part").parquet(f"{self.path}/{folder}")
            there = set(self._names(folder))
            tables[t] = {**kept, **{json.dumps(p): f"{folder}/part={i}" for i, p in enumerate(names) if f"part={i}" in there}}
        fresh = {**base, **meta, "version": VERSION, "tables": tables, "generation": base.get("generation") or uuid.uuid4().hex, "lastIngestAtIso": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        scope = None if "*" in base.get("tables", {}).get("chunks", {}) else touched  # written whole before: all are compared
        before = self._read(base, "chunks", scope) if base.get("tables") else self.spark.createDataFrame([], CHUNKS)
        fresh |= self._indexed(base, before, self._read(fresh, "chunks", scope))
        self._name(fresh, base.get("number", 0) + 1)
        return self.open()

    def retried(self, change: Callable[[dict], Snapshot | None]) -> Snapshot | None:
        """change(base), which writes a version upon the one that base describes; where another writer was first, again
        upon the newer one, TRIES times with growing waits."""
        for attempt in range(TRIES):
            try:
                return change(self.meta())
            except Conflict:
                if attempt + 1 == TRIES:
                    raise
                time.sleep(WAIT * (attempt + 1))

    def note(self, **meta: str) -> None:
        """Keeps values beside the index: a new version with the same tables."""
        self.retried(lambda base: self._name({**base, **meta}, base["number"] + 1))

    def vacuum(self, keep: int = 2) -> int:
        """Removes the folders and pointers that none of the newest `keep` versions names; how many folders went."""
        fs, path = self._fs()
        numbers = self._versions()
        used: set[str] = set()
        for n in numbers[-keep:]:
            named = self._meta_of(n)
            used |= {f.split("/")[0] for parts in named["tables"].values() for f in parts.values()}
            used |= {x["name"] for x in (*named.get("segments", []), *named.get("dead", []))} | set(named.get("folders", {}).values())
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.path}/current-{n:012d}"), False)
        gone = [n for n in self._names() if n.startswith(("v-", "seg-", "dead-", "side-")) and n not in used]
        for folder in gone:
            fs.delete(path(f"{self.path}/{folder}"), True)
        return len(gone)

    def side(self, name: str, schema: str) -> DataFrame:
        """A table that is kept beside the index under a name; empty where there is none."""
        folder = self.meta().get("folders", {}).get(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def put_side(self, name: str, rows: DataFrame) -> None:
        folder = f"side-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self.retried(lambda base: self._name({**base, "folders": {**base.get("folders", {}), name: folder}}, base["number"] + 1))

    def ingest(self, producer: str, delta: Snapshot, mode: str = "full", roots: DataFrame | None = None, **meta: str) -> Snapshot:
        """The store with the extract applied; producers without a row in it are not written again. The extract runs once,
        also where other writers are in the way: their versions stay, and it is applied to the newest."""
        delta = Snapshot(*(settle(getattr(delta, t)) for t in STORED))
        roots = None if roots is None else settle(roots)
        bare = mode != "delta" and all(getattr(delta, t).isEmpty() for t in STORED)

        def change(base: dict) -> Snapshot:
            before = self.at(base)
            if bare and not any({"*", json.dumps(producer)} & set(base["tables"][t]) for t in STORED):
                return before  # nothing of this producer, before or after
            after = apply_extract(before, producer, delta, mode, roots)
            return before if after is before else self.write(after, {producer} | owners(before, delta, None), base, **meta)

        return self.retried(change)

    def verify(self) -> dict[str, int]:
        """Counts as stored; an index without entities is an error."""
        state = self.open()
        counts = {t: getattr(state, t).count() for t in STORED}
        if not counts["entities"]:
            raise ValueError("the index has no entities")
        return counts

    @property
    def generation(self) -> str:
        return self.meta().get("generation", "")


def signatures_if_current(signatures: DataFrame, generation: str) -> DataFrame:
    """Signatures (id, sig, generation) of this generation; others are void."""
    return signatures.where(F.col("generation") == generation)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


__all__ = ["Column", "Snapshot", "Store", "replace"]
