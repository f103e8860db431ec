"""A project index over business tables: the projection of the warehouse tables into entities, edges and chunks.

The statements are plain SQL, so that any engine can build the same index from the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import aux_tokens
from ..operators.lineage import is_there, own_folder, spread
from ..operators.search import Index
from ..schema import EDGES as EDGES_SCHEMA
from ..schema import TABLES as SCHEMAS
from ..schema import validate

_stored: dict[tuple[str, str, str], str] = {}

_NULL = "CAST(NULL AS STRING)"


def _row(id: str, kind: str, name: str, path: str, parent: str, detail: str, source: str, producer: str, authority: str = "extracted-fact") -> str:
    return f"{id} AS id, '{kind}' AS kind, {name} AS name, {path} AS path, {parent} AS parent, '{source}' AS source, {_NULL} AS summary, {detail} AS detail, '{producer}' AS producer, '{authority}' AS authority"


def _id(table: str, key: str) -> str:
    return f"'asset:/Game/{table}/' || CAST({key} AS STRING)"


def _path(table: str, key: str) -> str:
    return f"'/Game/{table}/' || CAST({key} AS STRING)"


def _class(column: str) -> str:
    return f"""'{{{{"class":"' || {column} || '"}}}}'"""


_TITLE, _HEADING = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)", "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"
ENTITIES = " UNION ALL ".join([
    "SELECT " + _row(_id("part", "p_partkey"), "asset", "p_name", _path("part", "p_partkey"), _NULL, """'{{"assetClass":"' || CASE WHEN p_type = 'PROMO' THEN 'Texture2D' ELSE p_type END || '","class":"' || p_brand || '","size":' || CAST(p_size AS STRING) || '}}'""", "asset", "registry@1") + " FROM {part}",
    "SELECT " + _row(_id("supplier", "s_suppkey"), "blueprint", "s_name", _path("supplier", "s_suppkey"), _NULL, _NULL, "asset", "registry@1") + " FROM {supplier}",
    "SELECT " + _row(_id("region", "r_regionkey"), "asset", "r_name", _path("region", "r_regionkey"), _NULL, _NULL, "asset", "registry@1") + " FROM {region}",
    "SELECT " + _row(_id("nation", "n_nationkey"), "asset", "n_name", _path("nation", "n_nationkey"), _id("region", "n_regionkey"), _NULL, "asset", "registry@1") + " FROM {nation}",
    "SELECT " + _row(_id("customer", "c_custkey"), "asset", "c_name", _path("customer", "c_custkey"), _id("nation", "c_nationkey"), _class("c_mktsegment"), "asset", "assets@1") + " FROM {customer}",
    "SELECT " + _row(_id("customer", "o_custkey") + " || '::actor::' || CAST(o_orderkey AS STRING)", "level-actor", "'Order_' || CAST(o_orderkey AS STRING)", _path("customer", "o_custkey"), _id("customer", "o_custkey"), """'{{"class":"' || o_orderpriority || '","o_totalprice":' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || '}}'""", "asset", "assets@1") + " FROM {orders}",
    "SELECT " + _row("'doc:' || CAST(doc_id AS STRING)", "document", "'Document ' || CAST(doc_id AS STRING)", "'docs/' || source || '/' || CAST(doc_id AS STRING) || '.md'", _NULL, """'{{"docType":"' || source || '","lang":"' || lang || '"}}'""", "doc", "docs@1", "stated-intent") + " FROM {documents}",
    "SELECT " + _row("'doc:order/' || CAST(o_orderkey AS STRING) || '#note'", "doc-section", "'Note on order ' || CAST(o_orderkey AS STRING)", "'docs/orders.md'", "'doc:' || CAST(o_orderkey % 50 AS STRING)", _NULL, "doc", "docs@1", "stated-intent") + " FROM {orders}",
    "SELECT " + _row("'doc:page/' || CAST(page_id AS STRING)", "document", _TITLE, "url", _NULL, """'{{"docType":"web"}}'""", "doc", "docs@1", "stated-intent") + " FROM {pages}",
    "SELECT " + _row("'doc:page/' || CAST(page_id AS STRING) || '#heading'", "doc-section", _HEADING, "url", "'doc:page/' || CAST(page_id AS STRING)", _NULL, "doc", "docs@1", "stated-intent") + " FROM {pages}",
])

_ORDER = _id("customer", "o_custkey") + " || '::actor::' || CAST(o_orderkey AS STRING)"


def _edge(src: str, dst: str, type: str, tables: str, distinct: bool = False) -> str:
    return f"SELECT {'DISTINCT ' * distinct}{src} AS src, {dst} AS dst, {type} AS type, {_NULL} AS attrs, 'assets@1' AS producer FROM {tables}"


_LINES = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
_USES = "CASE l_returnflag WHEN 'A' THEN 'uses-material' WHEN 'N' THEN 'depends-on' ELSE 'references' END"
_TREE = " UNION ALL ".join([
    _edge(_id("part", "l_partkey"), _id("supplier", "l_suppkey"), "'depends-on'", "{lineitem}", True),
    _edge(_id("customer", "c_custkey"), _id("nation", "c_nationkey"), "'instance-of'", "{customer}"),
    _edge(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "'instance-of'", "{supplier}"),
    _edge(_id("nation", "n_nationkey"), _id("region", "n_regionkey"), "'inherits'", "{nation}"),
])
EDGES = " UNION ALL ".join([_edge(_ORDER, _id("part", "l_partkey"), _USES, _LINES, True), _edge(_ORDER, _id("customer", "o_custkey"), "'placed-in-level'", "{orders}"), _TREE])

NOTES = """SELECT 'doc:order/' || CAST(o_orderkey AS STRING) || '#note' AS id, 'Order placed in ' || n_name || ' for asset:/Game/part/' || CAST(o_orderkey % 2000 AS STRING) || ' with o_totalprice = ' || CAST(CAST(o_totalprice + o_orderkey % 2 AS DECIMAL(18,2)) AS STRING) AS text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
CHUNKS = " UNION ALL ".join([
    "SELECT 'c:doc:' || CAST(doc_id AS STRING) AS id, 'doc:' || CAST(doc_id AS STRING) AS entity_id, 'doc-section' AS kind, text FROM {documents}",
    f"SELECT 'c:part:' || CAST(p_partkey AS STRING) AS id, {_id('part', 'p_partkey')} AS entity_id, 'recipe-summary' AS kind, p_name || ' ' || p_type || ' ' || p_brand AS text FROM {{part}}",
    f"SELECT 'c:actor:' || CAST(o_orderkey AS STRING) AS id, {_ORDER} AS entity_id, 'recipe-summary' AS kind, 'urgent ring order ' || o_orderpriority AS text FROM {{orders}}",
    f"SELECT 'c:level:' || CAST(c_custkey AS STRING) AS id, {_id('customer', 'c_custkey')} AS entity_id, 'recipe-summary' AS kind, c_name || ' (Level) Actors: ' || CAST(c_custkey % 4 AS STRING) AS text FROM {{customer}}",
    f"SELECT 'c:note:' || id AS id, id AS entity_id, 'doc-section' AS kind, text FROM ({NOTES}) notes",
    f"SELECT 'c:page:' || CAST(page_id AS STRING) AS id, 'doc:page/' || CAST(page_id AS STRING) || '#heading' AS entity_id, 'doc-section' AS kind, {_TITLE} || ' ' || {_HEADING} AS text FROM {{pages}}",
])

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages")

#: Tables that texts are made of, with the key that they are dealt by.
SPREAD = {"documents": "doc_id", "pages": "page_id", "orders": "o_orderkey"}


class Project:
    """entities, edges and chunks of the tables in a folder, all lazy; and the same as a stored index."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose texts are read word by word, by as many tasks as there are."""
        return spread(self.table(name), SPREAD[name])

    def _sql(self, text: str, **given: DataFrame) -> DataFrame:
        return self.spark.sql(text, **{t: given[t] if t in given else self.table(t) for t in TABLES if f"{{{t}}}" in text})

    @property
    def entities(self) -> DataFrame:
        return validate(self._sql(ENTITIES), "entities")

    @property
    def edges(self) -> DataFrame:
        return validate(self._sql(EDGES), "edges")

    @property
    def chunks(self) -> DataFrame:
        return self._chunks(**{t: self.spread(t) for t in SPREAD})

    @property
    def chunk_rows(self) -> DataFrame:
        """The chunks, for work that doesn't read their texts: no table is dealt out."""
        return self._chunks()

    def _chunks(self, **given: DataFrame) -> DataFrame:
        return validate(self._sql(CHUNKS, **given).withColumn("aux", aux_tokens(F.col("entity_id"), F.col("text"))), "chunks")

    def _once(self, name: str, write: Callable[[str], None]) -> str:
        """The folder of a part of the stored index: written by the session's first query that needs it, in the folder that
        all executors share, and anew where it is gone."""
        path = _stored.get((self.spark.sparkContext.applicationId, self.sf_dir, name))
        if path is None or not is_there(self.spark, f"{path}/_done"):
            path = f"{own_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
            write(path)
            self.spark.range(1).write.parquet(f"{path}/_done")
            _stored[self.spark.sparkContext.applicationId, self.sf_dir, name] = path
        return path

    def edges_by(self, end: str) -> DataFrame:
        """The edges, stored in the order of one end (src or dst), so that those of a few nodes are in few row groups."""
        path = self._once(f"edges-{end}", lambda at: self.edges.repartitionByRange(end).sortWithinPartitions(end).write.parquet(f"{at}/edges"))
        return self.spark.read.schema(EDGES_SCHEMA).parquet(f"{path}/edges")

    def stored(self, table: str) -> DataFrame:
        """entities by id, or chunks by id, as a stored table."""
        path = self._once(table, lambda at: getattr(self, table).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{at}/rows"))
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{path}/rows")

    def index(self, name: str, chunks: Callable[[], DataFrame], stemmed: bool = False) -> Index:
        """The stored text index of some chunks."""
        return Index.load(self.spark, self._once(f"index-{name}", lambda at: Index.build(chunks(), stemmed).save(at)), stemmed)


def statement(text: str) -> str:
    """A statement for an engine in which the tables have their own names."""
    return text.format(**{t: t for t in TABLES})
