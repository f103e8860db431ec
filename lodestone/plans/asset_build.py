"""From a registry table of assets to the rows of three producers: inventory, recipes and levels, scripts.

The table has a row for each asset. What only a loaded asset tells stands in columns of their own, which are null where
nothing was loaded. The table is scanned once and parted by recipe; each recipe then reads its own part and columns."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import aux_tokens
from ..operators import assets
from ..operators.lineage import own_folder
from ..operators.store import Snapshot, union_all
from ..schema import CHUNKS, EDGES, ENTITIES, validate
from ..sources.files import is_shallow

REGISTRY, ASSETS, SCRIPTS = "registry@1", "assets@1", "scripts@1"
_LIGHT = "struct<intensity:double,red:int,green:int,blue:int,mobility:string,shadows:boolean,visible:boolean,radius:double,cone:double>"
SCHEMA = (
    "package string, name string, class string, tags map<string,string>, deps array<string>, sig string, "
    "mesh struct<lods:int,triangles:long,skeleton:string,materials:array<string>>, "
    "material struct<parent:string,blend:string,two_sided:boolean,textures:array<struct<param:string,texture:string>>>, "
    "mappings array<struct<seq:long,action:string,key:string,modifiers:array<string>,triggers:array<string>>>, "
    "facts struct<bones:long,row_struct:string,n_rows:long,value_type:string>, props string, defaults string, "
    f"actors array<struct<actor:string,label:string,class:string,class_package:string,location:string,light:{_LIGHT},mesh:string,props:string,defaults:string>>, "
    "members array<struct<member:string,name:string,type:string,ref:string,value:string>>"
)
# The classes that a recipe loads, and the column that holds what it loaded. Others are told by their tags.
LOADED = {
    "StaticMesh": "mesh",
    "SkeletalMesh": "mesh",
    "Material": "material",
    "MaterialInstanceConstant": "material",
    "InputMappingContext": "mappings",
    "Skeleton": "facts",
    "DataTable": "facts",
    "InputAction": "facts",
    "World": "actors",
}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry table of a folder of Parquet files, or of JSON lines if its name ends so. Absent columns are null."""
    reader = spark.read.schema(SCHEMA)
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)


def signatures(table: DataFrame) -> DataFrame:
    """id (package), sig: two columns of the table; an empty signature is always changed."""
    return table.select(F.col("package").alias("id"), F.coalesce("sig", F.lit("")).alias("sig"))


def _branch(shallow: tuple[str, ...]) -> Column:
    """The recipe of an asset: that of its class if the asset was loaded and isn't to be told shortly; `props` for other
    loaded ones; else `tags`."""
    out = F.when(F.col("props").isNotNull(), "props").otherwise("tags")
    for name, column in LOADED.items():
        out = F.when((F.col("class") == name) & F.col(column).isNotNull(), name).otherwise(out)
    return F.when(is_shallow(F.col("package"), shallow), "tags").otherwise(out)


@dataclass(frozen=True)
class Parts:
    """The assets, parted by recipe in one scan."""

    path: str
    spark: SparkSession

    @classmethod
    def of(cls, table: DataFrame, shallow: tuple[str, ...] = ()) -> Parts:
        path = f"{own_folder(table.sparkSession)}/assets-{uuid.uuid4().hex}"
        own = table.where(F.col("package").startswith("/Game")).withColumn("branch", _branch(shallow))
        own.repartition("branch", F.pmod(F.xxhash64("package"), F.lit(64))).write.partitionBy("branch").parquet(path)
        return cls(path, table.sparkSession)

    def all(self) -> DataFrame:
        whole = self.spark.read.schema(f"{SCHEMA}, branch string").parquet(self.path)
        return whole.withColumn("id", F.concat(F.lit("asset:"), F.col("package")))

    def __getitem__(self, branch: str) -> DataFrame:
        return self.all().where(F.col("branch") == branch)


def _none(spark: SparkSession) -> Snapshot:
    return Snapshot(spark.createDataFrame([], ENTITIES), spark.createDataFrame([], EDGES), spark.createDataFrame([], CHUNKS))


def _summaries(texts: DataFrame) -> DataFrame:
    """Chunks of summary texts (id, text)."""
    rows = texts.where("text <> ''").select(F.concat(F.lit("recipe:"), F.col("id")).alias("id"), F.col("id").alias("entity_id"), F.lit("recipe-summary").alias("kind"), "text")
    return validate(rows.withColumn("aux", aux_tokens(F.col("entity_id"), F.col("text"))), "chunks")


def inventory(parts: Parts) -> Snapshot:
    """Every asset with its dependencies; a script inherits its native class."""
    entities, edges = assets.registry(parts.all().select("package", "name", "class", "tags", "deps"))
    return Snapshot(validate(entities, "entities"), validate(edges, "edges"), _none(parts.spark).chunks)


def recipes(parts: Parts) -> tuple[DataFrame, DataFrame]:
    """Summary texts (id, text) and edges of all assets but levels, by the recipe of each."""
    told: list[DataFrame] = []
    edges: list[DataFrame] = []
    for name, skeletal in (("StaticMesh", False), ("SkeletalMesh", True)):
        rows = parts[name].select("id", "name", "mesh.*").withColumn("materials", F.coalesce("materials", F.array().cast("array<string>")))
        texts, found = assets.mesh_recipe(rows, skeletal)
        told, edges = [*told, texts], [*edges, found]
    for name in ("Material", "MaterialInstanceConstant"):
        texts, found = assets.material_recipe(parts[name].select("id", "name", "material.*"))
        told, edges = [*told, texts], [*edges, found]
    mappings = parts["InputMappingContext"].select("id", "name", F.explode("mappings").alias("m")).select("id", "name", "m.*")
    texts, found = assets.input_context_recipe(mappings)
    told, edges = [*told, texts], [*edges, found]
    for name in ("Skeleton", "DataTable", "InputAction"):
        told.append(assets.simple_recipe(parts[name].select("id", "name", "class", "facts.*")))
    objects = parts["props"].select(F.col("id").alias("owner"), "props", "defaults")
    texts, found = assets.property_diff(assets.flatten_properties(objects))
    told, edges = [*told, texts.withColumnRenamed("owner", "id")], [*edges, found]
    plain = parts["tags"]
    sized = plain.where("class = 'Texture2D'").select("id", assets.texture_text(F.col("name"), F.col("tags")).alias("text")).where("text is not null")
    texts, found = assets.tag_summary(plain.select("package", "tags"))
    rest = texts.join(sized.select("id"), "id", "left_anti").join(plain.select("id", "name", "class"), "id")
    told += [sized, rest.select("id", F.concat("name", F.lit(" ("), "class", F.lit(")\n"), "text").alias("text"))]
    shape = [f.name for f in EDGES]
    return union_all([t.select("id", "text") for t in told]), union_all([validate(e, "edges").select(*shape) for e in [*edges, found]])


def levels(parts: Parts) -> Snapshot:
    """Levels, the actors of them that are listed, and what they are placed from."""
    placed = parts["World"].select(F.col("package").alias("level"), F.explode("actors").alias("a")).select("level", "a.*")
    placed = placed.withColumn("id", F.concat(F.lit("asset:"), "level", F.lit("::actor::"), "actor"))
    objects = placed.where("props is not null").select(F.col("id").alias("owner"), "props", "defaults")
    told, references = assets.actor_detail(placed.drop("props", "defaults"), assets.flatten_properties(objects))
    entities, edges, texts, actors = assets.level_recipe(told)
    listed = entities.select(F.col("id").alias("src"))
    edges = validate(edges, "edges").unionByName(validate(references.join(listed, "src", "left_semi"), "edges"))
    actors = actors.withColumn("kind", F.lit("recipe-summary")).withColumn("aux", aux_tokens(F.col("entity_id"), F.col("text")))
    return Snapshot(validate(entities, "entities"), edges, _summaries(texts).unionByName(validate(actors, "chunks")))


def scripts(parts: Parts) -> Snapshot:
    """Functions, variables and components of scripts, and what they call, use, implement and bind."""
    members = parts.all().where("members is not null").select("package", F.explode("members").alias("m")).select("package", "m.*")
    entities, edges = assets.blueprint_structure(members)
    return Snapshot(validate(entities, "entities"), validate(edges.where("dst is not null"), "edges"), _none(parts.spark).chunks)


def snapshots(table: DataFrame, shallow: tuple[str, ...] = ()) -> dict[str, Snapshot]:
    """The rows of each producer, from one scan of the table. An edge that several recipes find is one row."""
    parts = Parts.of(table, shallow)
    texts, edges = recipes(parts)
    placed = levels(parts)
    both = edges.unionByName(placed.edges).dropDuplicates(["src", "dst", "type"])
    return {REGISTRY: inventory(parts), ASSETS: Snapshot(placed.entities, both, _summaries(texts).unionByName(placed.chunks)), SCRIPTS: scripts(parts)}
