"""Project statistics and health checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FACT
from .graph import class_of


def kinds(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def unused(entities: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """Assets and blueprints that nothing points to."""
    pointed = edges.select(F.col("dst").alias("id")).distinct()
    return entities.where(F.col("kind").isin("asset", "blueprint")).join(pointed, "id", "left_anti").orderBy("id").limit(limit).select("id", "kind", "name")


def largest_dependencies(entities: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Entities with most outgoing edges; edges are counted before they meet the entities."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return degree.join(entities.select("id", "kind", "name"), "id").orderBy(F.desc("n"), "id").limit(limit).select("id", "kind", "name", "n")


def authority(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("authority", F.lit(FACT)).alias("authority")).agg(F.count("*").alias("n"))


def doc_types(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'document'").groupBy(F.coalesce(F.get_json_object("detail", "$.docType"), F.lit("other")).alias("doc_type")).agg(F.count("*").alias("n"))


def overview(entities: DataFrame, edges: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """part, key, n: the total, counts by kind and by edge type; with meta also its values as part meta (n null)."""
    by_kind = kinds(entities)
    out = by_kind.agg(F.sum("n").alias("n")).select(F.lit("total").alias("part"), F.lit("entities").alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    out = out.unionByName(by_kind.select(F.lit("kind").alias("part"), F.col("kind").alias("key"), "n"))
    out = out.unionByName(edge_types(edges).select(F.lit("edge").alias("part"), F.col("type").alias("key"), "n"))
    if meta is not None:
        out = out.unionByName(meta.where(F.col("key").isin("lastIngestAtIso", "lastGeneratedAtIso", "projectName")).select(F.lit("meta").alias("part"), F.concat_ws("=", "key", "value").alias("key"), F.lit(None).cast("long").alias("n")))
    return out


def project_stats(entities: DataFrame, edges: DataFrame, facet: str = "", meta: DataFrame | None = None) -> DataFrame:
    """The facet's answer; an unknown facet is the overview."""
    facets = {
        "kinds": lambda: kinds(entities).orderBy(F.desc("n"), "kind"),
        "edges": lambda: edge_types(edges).orderBy(F.desc("n"), "type"),
        "unused": lambda: unused(entities, edges),
        "largest-deps": lambda: largest_dependencies(entities, edges),
        "authority": lambda: authority(entities).orderBy(F.desc("n"), "authority"),
        "doc-types": lambda: doc_types(entities).orderBy(F.desc("n"), "doc_type"),
    }
    return facets.get(facet, lambda: overview(entities, edges, meta))()


def by_producer(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("producer", F.lit("(none)")).alias("producer")).agg(F.count("*").alias("n"))


def level_coverage(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each level's summary chunk: how many actors it states, how many children are indexed, and whether it states
    some and has none."""
    stated = chunks.where(F.col("kind") == "recipe-summary").where(F.col("text").rlike(r"(?s)\(Level\).*Actors: [0-9]")).select("entity_id", F.regexp_extract("text", r"Actors: ([0-9]+)", 1).cast("long").alias("stated"))
    held = entities.where("parent is not null").groupBy(F.col("parent").alias("entity_id")).agg(F.count("*").alias("indexed"))
    return stated.join(held, "entity_id", "left").select("entity_id", "stated", F.coalesce("indexed", F.lit(0)).alias("indexed"), ((F.col("stated") > 0) & F.col("indexed").isNull()).alias("problem"))


def doctor(entities: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """check, n, ok: table sizes, orphaned chunks, repeated keys and uncovered levels. The index is healthy if all are ok."""
    checks = [(name, df.agg(F.count("*").alias("n")), "n > 0" if name == "entities" else "true") for name, df in (("entities", entities), ("edges", edges), ("chunks", chunks))]
    checks.append(("chunks-without-entity", chunks.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").agg(F.count("*").alias("n")), "n = 0"))
    checks.append(("repeated-entities", entities.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n")), "n = 0"))
    checks.append(("levels-without-actors", level_coverage(entities, chunks).where("problem").agg(F.count("*").alias("n")), "n = 0"))
    out = None
    for name, df, rule in checks:
        row = df.select(F.lit(name).alias("check"), "n", F.expr(rule).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def upkeep(chunks: DataFrame, lengths: DataFrame, version: int, expected: int | None = None) -> DataFrame:
    """check, n, ok: the version of the schema, and chunks that the text index hasn't (or has beyond them)."""
    from .store import VERSION

    expected = VERSION if expected is None else expected
    ids, indexed = chunks.select("id"), lengths.select(F.col("chunk_id").alias("id"))
    apart = ids.join(indexed, "id", "left_anti").unionByName(indexed.join(ids, "id", "left_anti")).agg(F.count("*").alias("n"))
    rows = apart.select(F.lit("index-out-of-step").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    return rows.unionByName(chunks.sparkSession.createDataFrame([("schema-version", int(version), int(version) == expected)], "check string, n long, ok boolean"))


def verdict(checks: DataFrame) -> DataFrame:
    """checks with a last one, `healthy`: how many of them aren't ok."""
    return checks.unionByName(checks.agg(F.count_if(~F.col("ok")).alias("n")).select(F.lit("healthy").alias("check"), "n", (F.col("n") == 0).alias("ok")))


def freshness(spark: SparkSession, meta: dict, now: str | None = None) -> DataFrame:
    """check, n, ok by what the store notes: tables that its version should name and doesn't, whether the last build failed,
    and, where the sources' fingerprint `now` is given, whether they have changed since the last good build."""
    missing = sorted({"entities", "edges", "chunks"} - set(meta.get("tables", {})))
    last = json.loads(meta.get("lastResult", "{}"))
    rows = [("missing-tables", len(missing), not missing), ("failed-stages", len(last.get("failed", [])), last.get("ok", True))]
    if now is not None:
        rows.append(("sources-changed", int(meta.get("fingerprint") != now), meta.get("fingerprint") == now))
    return spark.createDataFrame(rows, "check string, n long, ok boolean")


# Classes that are counted but not listed, and words of classes that make the look of a level.
DERIVED = ("WorldPartitionHLOD", "WorldPartitionMiniMap", "HLODActor")


def class_histogram(actors: DataFrame) -> DataFrame:
    return actors.groupBy("level", "class").agg(F.count("*").alias("n"))


def select_actors(actors: DataFrame, limit: int = 500) -> DataFrame:
    """The actors of each level that are listed: in turns by class, the rarest class first, derived ones left out."""
    kept = actors.where(~F.col("class").isin(*DERIVED))
    turn = F.row_number().over(Window.partitionBy("level", "class").orderBy("actor"))
    size = F.count("*").over(Window.partitionBy("level", "class"))
    ranked = kept.withColumn("turn", turn).withColumn("class_size", size)
    place = F.row_number().over(Window.partitionBy("level").orderBy("turn", "class_size", "class", "actor"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).select("level", "actor", "class", F.col("place").cast("long").alias("place"))


__all__ = ["class_of"]
