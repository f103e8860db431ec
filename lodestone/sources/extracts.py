"""Extract documents: one JSON file of a producer with entities, edges and chunks, full or delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Snapshot
from ..schema import TABLES, json_object, validate

_ENTITY = "array<struct<id:string,kind:string,name:string,path:string,parent:string,source:string,summary:string,detail:string,authority:string>>"
_EDGE = "array<struct<src:string,dst:string,type:string,attrs:string>>"
_CHUNK = "array<struct<id:string,entityId:string,kind:string,text:string>>"
SCHEMA = f"schemaVersion int, generatedAtIso string, producer string, project struct<name:string,root:string>, mode string, replaces array<string>, entities {_ENTITY}, edges {_EDGE}, chunks {_CHUNK}, _corrupt_record string"


def read_extracts(spark: SparkSession, folder: str, only: str = "", skip: str = "") -> DataFrame:
    """A row for each readable document of the folder with a producer; signature caches and temporary files are left out.
    only and skip are file names, joined by +."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    named = files.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    named = named.where(~F.col("file").endswith("-hashes.json"))
    if only:
        named = named.where(F.col("file").isin(*only.split("+")))
    if skip:
        named = named.where(~F.col("file").isin(*skip.split("+")))
    return named.where("_corrupt_record is null and producer is not null and producer <> ''").drop("_corrupt_record")


def snapshot_of(extracts: DataFrame) -> Snapshot:
    """The rows of extracts as tables; empty texts of optional columns are null, and details that aren't objects."""
    from ..functions.text import aux_tokens

    def rows(column: str) -> DataFrame:
        return extracts.select("producer", F.explode(column).alias("x")).select("producer", "x.*")

    entities = rows("entities").withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("parent", "summary")}).withColumn("detail", json_object(F.col("detail")))
    edges = rows("edges").withColumn("attrs", json_object(F.col("attrs")))
    chunks = rows("chunks").withColumnRenamed("entityId", "entity_id").withColumn("aux", aux_tokens(F.col("entity_id"), F.col("text")))
    return Snapshot(validate(entities, "entities"), validate(edges, "edges"), validate(chunks, "chunks"))


def write_extract(state: Snapshot, path: str, producer: str, project: str, root: str, generated_at: str, replaces: list[str] | None = None) -> None:
    """Write tables as one document for each producer's rows of a group; `replaces` makes it a delta.

    The document is one JSON value by its format, so this is for extracts of a bounded size; whole indexes are stored as
    Parquet (operators.store.Store)."""
    spark = state.entities.sparkSession

    def packed(table: str, columns: dict[str, str]) -> DataFrame:
        df = getattr(state, table)
        return df.agg(F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in columns.items()])).alias(table)).withColumn("one", F.lit(1))

    head = spark.range(1).select(F.lit(1).alias("one"), F.lit(1).alias("schemaVersion"), F.lit(generated_at).alias("generatedAtIso"), F.lit(producer).alias("producer"), F.struct(F.lit(project).alias("name"), F.lit(root).alias("root")).alias("project"))
    if replaces is not None:
        head = head.withColumn("mode", F.lit("delta")).withColumn("replaces", F.array(*map(F.lit, replaces)).cast("array<string>"))
    out = head
    for table, columns in (("entities", {c: c for c in TABLES["entities"].names if c != "producer"}), ("edges", {c: c for c in ("src", "dst", "type", "attrs")}), ("chunks", {"id": "id", "entity_id": "entityId", "kind": "kind", "text": "text"})):
        out = out.join(packed(table, columns), "one")
    out.drop("one").coalesce(1).write.mode("overwrite").json(path)
