"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only on a local master where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestone-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and held in the checkpoint folder that all executors share; lost executors don't lose it."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Plan nodes that only scan, prune and filter stored rows.
_CHEAP = ("Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Union", "SubqueryAlias", "Relation")


def _only_scans(node) -> bool:
    """Whether a logical plan has nothing but cheap nodes, and reads tables or a few local rows."""
    if node.nodeName() not in _CHEAP:
        return False
    children = node.children()
    return all(_only_scans(children.apply(i)) for i in range(children.size()))


def settle(df: DataFrame) -> DataFrame:
    """df for repeated reading: itself if it only scans and filters stored tables, else as a table in the shared folder,
    so that each of its readers prunes columns and none computes its joins and aggregations again."""
    spark = df.sparkSession
    if _only_scans(df._jdf.queryExecution().optimizedPlan()):
        return df
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_rows(df: DataFrame, keep: Column, **metrics: Column) -> tuple[DataFrame, dict]:
    """The rows of df that are to be kept, computed once and stored in the shared folder; and aggregates of all its rows,
    which are taken on the way."""
    spark, told = df.sparkSession, Observation()
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.observe(told, *[c.alias(name) for name, c in metrics.items()]).where(keep).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), told.get


#: Rows that one task may hold before they are dealt out.
MOST_ROWS = 5000


def spread(df: DataFrame, key: str) -> DataFrame:
    """A stored table for work that costs much a row: dealt out by key where fewer tasks hold its rows than there are cores,
    as those of a file with few row groups do."""
    tasks = df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, key) if tasks["n"] < cores and (tasks["most"] or 0) > MOST_ROWS else df


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_there(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def own_folder(spark: SparkSession) -> str:
    """A folder of this application within the shared one; it goes when the driver ends."""
    root = f"{shared_folder(spark)}/lodestone-tables-{spark.sparkContext.applicationId}"
    if root not in _own:
        _own[root] = root

        def remove() -> None:
            if getattr(spark.sparkContext, "_jsc", None) is not None:
                fs, path = _path(spark, root)
                fs.delete(path, True)

        atexit.register(remove)
    return root
