"""The change feed: saves, deletes and renames of packages, applied to an index by Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.graph import subtree
from ..operators.lineage import settle
from ..operators.store import Snapshot, Store, owners, patch

SCHEMA = "seq long, ts timestamp, op string, package string, old_package string"
SKIPPED = ("__ExternalActors__", "__ExternalObjects__")


def wanted(events: DataFrame) -> DataFrame:
    """Events of project packages; a rename also deletes its old package."""
    renames = events.where("op = 'rename' and old_package is not null").select("seq", "ts", F.lit("delete").alias("op"), F.col("old_package").alias("package"))
    own = events.select("seq", "ts", F.when(F.col("op") == "rename", "save").otherwise(F.col("op")).alias("op"), "package")
    out = own.unionByName(renames).where(F.startswith("package", F.lit("/Game")))
    for part in SKIPPED:
        out = out.where(~F.col("package").contains(part))
    return out


def latest_changes(events: DataFrame) -> DataFrame:
    """The last event of each package by seq (files don't arrive in order); of one seq, a save wins."""
    order = Window.partitionBy("package").orderBy(F.desc("seq"), F.desc("op"))
    return wanted(events).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def apply_changes(state: Snapshot, events: DataFrame, extract: Callable[[DataFrame], Snapshot], producer: str, applied: DataFrame | None = None) -> tuple[Snapshot, DataFrame]:
    """The index after the events, and the last seq of each package; events that aren't newer than `applied` are ignored.

    Saved packages are extracted again and replace their subtrees; deleted ones lose theirs."""
    last = latest_changes(events)
    if applied is not None:
        last = last.join(applied.select("package", F.col("seq").alias("done")), "package", "left").where("done is null or seq > done").drop("done")
    saved = last.where("op = 'save'")
    roots = last.select(F.concat(F.lit("asset:"), F.col("package")).alias("id"))
    after = patch(state, extract(saved.select("package")), producer, roots)
    fresh = last.select("package", "seq")
    kept = fresh if applied is None else applied.join(fresh, "package", "left_anti").select("package", "seq").unionByName(fresh)
    return after, kept


def read_changes(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder)


class Newest(StatefulProcessor):
    """Keyed by package: lets the newest event through, if it is newer than the last one that went through.

    The state is one number a package, in the state store of the stream: a batch reads and writes the packages of its own
    events, whatever was ever seen. It is committed with the batch, so a batch that is run again decides the same."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the interface's names
        last = max(rows, key=lambda r: (r.seq, r.op))
        held = self.done.get()
        if held is None or last.seq > held[0]:
            self.done.update((last.seq,))
            yield Row(package=key[0], seq=last.seq, op=last.op)

    def close(self) -> None:
        pass


def newest_events(events: DataFrame) -> DataFrame:
    """package, seq, op of a stream's events that are the newest of their package so far; late and repeated ones go."""
    return wanted(events).select("package", "seq", "op").groupBy("package").transformWithState(Newest(), "package string, seq long, op string", "update", "none")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(events: DataFrame, store: Store, extract: Callable[[DataFrame], Snapshot], producer: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a stream of events to a store batch by batch: saved packages are extracted, once a batch, and replace their
    subtrees; deleted ones lose theirs. The store notes the last batch of the stream with the version that it made, so a
    batch that runs again after a failure changes nothing."""
    stream = f"stream-{hashlib.md5(checkpoint.encode()).hexdigest()}"

    def batch(df: DataFrame, number: int) -> None:
        last = settle(df)
        if last.isEmpty():
            return
        delta = extract(last.where("op = 'save'").select("package"))
        delta = Snapshot(*(settle(getattr(delta, t)) for t in ("entities", "edges", "chunks")))
        roots = last.select(F.concat(F.lit("asset:"), "package").alias("id"))

        def change(base: dict) -> Snapshot | None:
            if int(base.get(stream, -1)) >= number:
                return None
            before = store.at(base)
            gone = settle(subtree(before.entities, roots))
            after = patch(before, delta, producer, roots)
            return store.write(after, {producer} | owners(before, delta, gone), base, **{stream: str(number)})

        store.retried(change)

    conf = store.spark.conf
    usual = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)  # what this stream starts with; other streams keep the session's own
    try:
        writer = newest_events(events).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()
    finally:
        conf.unset(_PROVIDER) if usual is None else conf.set(_PROVIDER, usual)
