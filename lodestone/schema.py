"""The three tables of a project index, and the closed vocabularies that queries depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()


def _table(*names: str, needed: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT, n not in needed) for n in names])


ENTITIES = _table("id", "kind", "name", "path", "parent", "source", "summary", "detail", "producer", "authority", needed=("id", "kind", "name", "path", "source"))
EDGES = _table("src", "dst", "type", "attrs", "producer", needed=("src", "dst", "type"))
CHUNKS = _table("id", "entity_id", "kind", "text", "aux", "producer", needed=("id", "entity_id", "kind", "text"))
META = _table("key", "value", needed=("key", "value"))
TABLES = {"entities": ENTITIES, "edges": EDGES, "chunks": CHUNKS, "meta": META}
KEYS = {"entities": ["id"], "edges": ["src", "dst", "type"], "chunks": ["id"], "meta": ["key"]}

FACT, INTENT = "extracted-fact", "stated-intent"

# How much a dependent suffers, by the type of its edge; other types weigh 1.
SEVERITY = {"inherits": 10, "implements": 9, "calls": 8, "uses-skeleton": 8, "binds-input": 7, "uses-material": 7, "overrides-parameter": 6, "casts-to": 6, "uses-texture": 5, "placed-in-level": 5, "instance-of": 5, "plays-on": 4, "depends-on": 4, "references": 3, "describes": 2, "constrains": 2, "illustrates": 2}
# Score factors of matches that tell little.
DEMOTED_KIND, DEMOTED_CHUNK, DEMOTED_CLASS = {"level-actor": 0.35}, {"cpp-body": 0.7}, 0.5
BULK_CLASSES = ("Texture2D", "TextureCube", "Texture2DArray", "VirtualTexture2D", "MaterialInstanceConstant", "MaterialFunction")
INTENT_KINDS = ("document", "doc-section", "image")


def validate(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order; absent optional columns are null, absent needed ones an error."""
    columns = []
    for field in TABLES[table].fields:
        if field.name in df.columns:
            columns.append(F.col(field.name).cast("string").alias(field.name))
        elif field.nullable:
            columns.append(F.lit(None).cast("string").alias(field.name))
        else:
            raise ValueError(f"{table} lacks {field.name}")
    return df.select(*columns)


def blank_to_null(column: Column | str) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def json_object(column: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.when(F.ltrim(column).startswith("{") & F.get_json_object(column, "$").isNotNull(), column)


def entity(id: Column, kind: str, name: Column, path: Column, source: str, parent: Column | None = None, summary: Column | None = None, detail: Column | None = None, authority: str | None = None, producer: str | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    return [
        id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"),
        (blank_to_null(parent) if parent is not None else null).alias("parent"), F.lit(source).alias("source"),
        (blank_to_null(summary) if summary is not None else null).alias("summary"),
        (json_object(detail) if detail is not None else null).alias("detail"),
        F.lit(producer).cast("string").alias("producer"),
        F.lit(authority or (INTENT if kind in INTENT_KINDS else FACT)).alias("authority"),
    ]


def edge(src: Column, dst: Column, type: Column | str, via: Column | None = None, producer: str | None = None) -> list[Column]:
    attrs = F.to_json(F.struct(via.alias("via"))) if via is not None else F.lit(None).cast("string")
    return [src.alias("src"), dst.alias("dst"), (F.lit(type) if isinstance(type, str) else type).alias("type"), attrs.alias("attrs"), F.lit(producer).cast("string").alias("producer")]


def chunk(id: Column, entity_id: Column, kind: str, text: Column, producer: str | None = None) -> list[Column]:
    from .functions.text import aux_tokens

    return [id.alias("id"), entity_id.alias("entity_id"), F.lit(kind).alias("kind"), text.alias("text"), aux_tokens(entity_id, text).alias("aux"), F.lit(producer).cast("string").alias("producer")]


def project_entity() -> list[Column]:
    """The fixed projection that answers carry."""
    return [F.col("id"), F.col("kind"), F.col("name"), F.col("path"), blank_to_null("parent").alias("parent"), F.col("source"), blank_to_null("summary").alias("summary"), F.col("detail"), F.coalesce("authority", F.lit(FACT)).alias("authority")]
