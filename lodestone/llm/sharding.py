"""Sharding: contiguous shards of near equal bytes, cut from global prefix sums of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, prefix_offsets, shuffle_partitions

PLACED = "doc_id long, size long, text_crc32 long, part int, start long, row long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes and rows that come before each row in its own sorted partition."""
    from pyspark import TaskContext

    part, before, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        sizes = batch.column("size").to_numpy()
        ends = before + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends - sizes), pa.array(np.arange(rows, rows + n))], names=["doc_id", "size", "text_crc32", "part", "start", "row"])
        before, rows = int(ends[-1]) if n else before, rows + n


def shard_of(start: Column, size: Column, total: int, n_shards: int) -> Column:
    """The shard of n in which the middle of the bytes from start lies; whole numbers of 38 digits, exact for any total."""
    middle = (start.cast("decimal(20,0)") * 2 + size).cast("decimal(22,0)") * n_shards
    rest = middle % F.lit(max(1, 2 * total)).cast("decimal(22,0)")
    return F.least(((middle - rest) / F.lit(max(1, 2 * total)).cast("decimal(22,0)")).cast("int"), F.lit(n_shards - 1))


def shard_by_bytes(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards of near equal bytes, in ascending order of id.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1). One range partitioning sorts (id, size, crc32)
    without the texts; each partition adds up its own sizes; only its total goes to the driver (as many numbers as
    there are partitions). A row lies in the shard in which the middle of its bytes lies, so each cut is at most half
    a row from its equal target.

    Returns doc_id, size, text_crc32 (of the empty text for null), law ("bytes"), shard, slot (place in the shard,
    gapless from 0), grown_shard (null: cuts move when the count of shards changes). Rows of one id are ordered by
    size and crc32; rows equal in all three are interchangeable. Null ids come first. An empty table gives no rows.
    Other columns are ignored."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = ["doc_id", "size", "text_crc32"]
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ranged = narrow.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = materialize(map_arrow(ranged, _running, PLACED), "sizes")

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    total = sum(r["bytes"] for r in totals)
    before = spark.createDataFrame(prefix_offsets([tuple(r) for r in totals]), "part int, bytes_before long, rows_before long")
    start = F.col("start") + F.col("bytes_before")
    dealt = placed.join(F.broadcast(before), "part").select(*keys, shard_of(start, F.col("size"), total, n_shards).alias("shard"), (F.col("row") + F.col("rows_before")).alias("row"))
    first = {r["shard"]: r["first"] for r in dealt.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    firsts = F.lit(0).cast("long")
    for shard, row in first.items():
        firsts = F.when(F.col("shard") == shard, F.lit(row).cast("long")).otherwise(firsts)
    return dealt.select(*keys, F.lit("bytes").alias("law"), "shard", (F.col("row") - firsts).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write df's rows as one folder for each shard, in slot order; df's ids must be unique."""
    placed = df.join(shards.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.repartitionByRange(shuffle_partitions(df.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
