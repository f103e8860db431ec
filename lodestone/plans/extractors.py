"""Queries of the asset, level and script extractors over inputs that are made of the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assets, intent
from ..sources.projection import Project
from .core import CAMEL, query


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


ID = "'asset:/Game/part/' || CAST(p_partkey AS STRING)"


def _id() -> Column:
    return _cat("asset:/Game/part/", _s("p_partkey"))



def _edges(frame: DataFrame) -> DataFrame:
    return frame.select("src", "dst", "type", F.coalesce("attrs", F.lit("")).alias("attrs"))


# --- the asset registry


def _registry(p: Project) -> tuple[DataFrame, DataFrame]:
    parts = p.table("part")
    package = F.when(F.col("p_partkey") % 7 == 0, _cat("/Engine/part/", _s("p_partkey"))).otherwise(_cat("/Game/part/", _s("p_partkey")))
    script = F.col("p_partkey") % 5 == 0
    native = F.create_map(F.lit("NativeParentClass"), F.when(F.col("p_partkey") % 2 == 0, _cat("/Script/CoreUObject.Class'/Script/Shop.", F.regexp_replace("p_brand", "[^A-Za-z]", ""), "'")).otherwise(""))
    deps = F.array(_cat("/Game/part/", (F.col("p_partkey") + 1).cast("string")), F.lit("/Engine/Basic"), _cat("/Game/part/", (F.col("p_partkey") + 1).cast("string")))
    rows = parts.select(package.alias("package"), F.col("p_name").alias("name"), F.when(script, "Blueprint").otherwise(F.col("p_type")).alias("class"), native.alias("tags"), deps.alias("deps"))
    return assets.registry(rows)


query("registry_entities", f"""SELECT {ID} AS id, CASE WHEN p_partkey % 5 = 0 THEN 'blueprint' ELSE 'asset' END AS kind, p_name AS name, '{{"assetClass":"' || CASE WHEN p_partkey % 5 = 0 THEN 'Blueprint' ELSE p_type END || '"}}' AS detail FROM part WHERE p_partkey % 7 <> 0""")(lambda p: _registry(p)[0].select("id", "kind", "name", "detail"))
query("registry_edges", f"SELECT {ID} AS src, 'asset:/Game/part/' || CAST(p_partkey + 1 AS STRING) AS dst, 'depends-on' AS type, '' AS attrs FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT {ID}, 'cpp:' || regexp_replace(p_brand, '[^A-Za-z]', '', 'g'), 'inherits', '' FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 10 = 0")(lambda p: _edges(_registry(p)[1]))


# --- meshes, textures, materials, small recipes


def _meshes(p: Project, skeletal: bool) -> tuple[DataFrame, DataFrame]:
    more = F.when(F.col("p_size") % 4 > 0, _cat("/Game/rigs/Rig", (F.col("p_size") % 4).cast("string"))).alias("skeleton") if skeletal else (F.col("p_partkey") * 12).alias("triangles")
    second = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("/Game/mat/Rim"))).otherwise(F.array().cast("array<string>"))
    rows = p.table("part").select(_id().alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 5 + 1).alias("lods"), F.concat(F.array(_cat("/Game/mat/", F.col("p_type"))), second).alias("materials"), more)
    return assets.mesh_recipe(rows, skeletal)


_SLOTS = "CASE WHEN p_size % 3 = 0 THEN '2' ELSE '1' END || chr(10) || 'Materials: ' || p_type || CASE WHEN p_size % 3 = 0 THEN ', Rim' ELSE '' END"
_MATERIALS = f"SELECT {ID} AS src, 'asset:/Game/mat/' || p_type AS dst, 'uses-material' AS type, '' AS attrs FROM part UNION ALL SELECT {ID}, 'asset:/Game/mat/Rim', 'uses-material', '' FROM part WHERE p_size % 3 = 0"
query("static_mesh_text", f"SELECT {ID} AS id, p_name || ' (StaticMesh)' || chr(10) || 'LODs: ' || CAST(p_size % 5 + 1 AS STRING) || ', Triangles(LOD0): ' || CAST(p_partkey * 12 AS STRING) || ', Material slots: ' || {_SLOTS} AS text FROM part")(lambda p: _meshes(p, False)[0])
query("static_mesh_edges", _MATERIALS)(lambda p: _edges(_meshes(p, False)[1]))
query("skeletal_mesh_text", f"SELECT {ID} AS id, p_name || ' (SkeletalMesh)' || chr(10) || 'Skeleton: ' || CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'Rig1' WHEN 2 THEN 'Rig2' ELSE 'Rig3' END || ', LODs: ' || CAST(p_size % 5 + 1 AS STRING) || ', Material slots: ' || {_SLOTS} AS text FROM part")(lambda p: _meshes(p, True)[0])
query("skeletal_mesh_edges", f"{_MATERIALS} UNION ALL SELECT {ID}, 'asset:/Game/rigs/Rig' || CAST(p_size % 4 AS STRING), 'uses-skeleton', '' FROM part WHERE p_size % 4 > 0")(lambda p: _edges(_meshes(p, True)[1]))


@query("texture_text", f"SELECT {ID} AS id, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_name || ' (Texture2D)' || chr(10) || CAST(p_size AS STRING) || 'x' || CAST(p_size * 2 AS STRING) END AS text FROM part")
def _textures(p: Project) -> DataFrame:
    sizes = F.when(F.col("p_size") % 6 == 0, F.lit("unknown")).when(F.col("p_size") % 2 == 0, F.concat_ws("x", _s("p_size"), (F.col("p_size") * 2).cast("string"))).otherwise(F.concat_ws("X", _s("p_size"), (F.col("p_size") * 2).cast("string")))
    return p.table("part").select(_id().alias("id"), assets.texture_text(F.col("p_name"), F.create_map(F.lit("Dimensions"), sizes)).alias("text"))


def _materials(p: Project) -> tuple[DataFrame, DataFrame]:
    pair = lambda name, path: F.struct(F.lit(name).alias("param"), path.alias("texture"))
    textures = F.concat(F.array(pair("Base", _cat("/Game/tex/", F.col("p_type")))), F.when(F.col("p_size") % 2 == 0, F.array(pair("Mask", F.lit("/Game/tex/Grime")))).otherwise(F.array().cast("array<struct<param:string,texture:string>>")))
    rows = p.table("part").select(_id().alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 > 0, "/Game/mat/Master").alias("parent"), F.when(F.col("p_size") % 5 == 0, "Translucent").otherwise("Opaque").alias("blend"), (F.col("p_size") % 7 == 0).alias("two_sided"), textures.alias("textures"))
    return assets.material_recipe(rows)


query(
    "material_text",
    f"SELECT {ID} AS id, p_name || CASE WHEN p_size % 3 > 0 THEN ' (MaterialInstance)' || chr(10) || 'Parent: Master' ELSE ' (Material)' END || chr(10) || 'Blend: ' || CASE WHEN p_size % 5 = 0 THEN 'Translucent' ELSE 'Opaque' END || ', TwoSided: ' || CASE WHEN p_size % 7 = 0 THEN 'yes' ELSE 'no' END || ', Textures: ' || CASE WHEN p_size % 2 = 0 THEN '2' ELSE '1' END || chr(10) || CASE WHEN p_size % 3 > 0 THEN 'Base=' ELSE '' END || p_type || CASE WHEN p_size % 2 > 0 THEN '' WHEN p_size % 3 > 0 THEN ', Mask=Grime' ELSE ', Grime' END AS text FROM part",
)(lambda p: _materials(p)[0])
query(
    "material_edges",
    f"""SELECT {ID} AS src, 'asset:/Game/tex/' || p_type AS dst, 'uses-texture' AS type, CASE WHEN p_size % 3 > 0 THEN '{{"via":"Base"}}' ELSE '' END AS attrs FROM part UNION ALL SELECT {ID}, 'asset:/Game/tex/Grime', 'uses-texture', CASE WHEN p_size % 3 > 0 THEN '{{"via":"Mask"}}' ELSE '' END FROM part WHERE p_size % 2 = 0 UNION ALL SELECT {ID}, 'asset:/Game/mat/Master', 'references', '{{"via":"parent"}}' FROM part WHERE p_size % 3 > 0""",
)(lambda p: _edges(_materials(p)[1]))


@query("small_recipes", f"SELECT {ID} AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (Skeleton)' || chr(10) || 'Bones: ' || CAST(p_size AS STRING) WHEN 1 THEN ' (DataTable)' || chr(10) || 'Row struct: ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'none' END || ', Rows: ' || CAST(p_size * 3 AS STRING) ELSE ' (InputAction)' || chr(10) || 'ValueType: ' || p_brand END AS text FROM part WHERE p_partkey % 4 < 3")
def _small(p: Project) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("Skeleton", "DataTable", "InputAction", "SoundCue"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return assets.simple_recipe(p.table("part").select(_id().alias("id"), F.col("p_name").alias("name"), kinds.alias("class"), F.col("p_size").alias("bones"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("row_struct"), (F.col("p_size") * 3).alias("n_rows"), F.col("p_brand").alias("value_type")))


def _mappings(p: Project) -> tuple[DataFrame, DataFrame]:
    key = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    action = F.when(key % 6 > 0, _cat("/Game/input/IA_", F.col("n_name")))
    rows = p.table("nation").select(_cat("asset:/Game/input/IMC_", _s("n_regionkey")).alias("id"), _cat("IMC_", _s("n_regionkey")).alias("name"), key.alias("seq"), action.alias("action"), _cat("K", _s("n_nationkey")).alias("key"), F.when(key % 2 == 0, F.array(F.lit("InputModifierNegate"), F.lit("InputModifierSwizzle"))).otherwise(none).alias("modifiers"), F.when(key % 3 == 0, F.array(F.lit("InputTriggerHold"))).otherwise(none).alias("triggers"))
    return assets.input_context_recipe(rows)


query(
    "input_context_text",
    "SELECT 'asset:/Game/input/IMC_' || CAST(n_regionkey AS STRING) AS id, 'IMC_' || CAST(n_regionkey AS STRING) || ' (InputMappingContext)' || chr(10) || 'Mappings (' || CAST(count(*) AS STRING) || '):' || chr(10) || string_agg(CASE WHEN n_nationkey % 6 > 0 THEN 'IA_' || n_name ELSE '<none>' END || ' <- K' || CAST(n_nationkey AS STRING) || CASE WHEN n_nationkey % 2 = 0 THEN ' [Negate,Swizzle]' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN ' (Hold)' ELSE '' END, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey",
)(lambda p: _mappings(p)[0])
query("input_context_edges", """SELECT 'asset:/Game/input/IMC_' || CAST(n_regionkey AS STRING) AS src, 'asset:/Game/input/IA_' || n_name AS dst, 'references' AS type, '{"via":"maps"}' AS attrs FROM nation WHERE n_nationkey % 6 > 0""")(lambda p: _edges(_mappings(p)[1]))


# --- levels: a nation is a level, its customers are the actors

_ACTORS = """a AS (SELECT '/Game/maps/' || n_name AS level, n_name AS name, 'Actor' || CAST(c_custkey AS STRING) AS actor, CASE WHEN c_custkey % 5 = 0 THEN 'SkyDome_' ELSE 'Thing_' END || CAST(c_custkey AS STRING) AS label, CASE c_custkey % 6 WHEN 0 THEN 'DirectionalLight' WHEN 1 THEN 'StaticMeshActor' WHEN 2 THEN 'HLODActor' WHEN 3 THEN 'BP_Torch_C' ELSE c_mktsegment END AS class, c_custkey % 6 = 3 AS script, c_custkey AS k, c_acctbal AS v, c_mktsegment AS m FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _actors(p: Project) -> DataFrame:
    rows = p.table("customer").join(p.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    kind = F.when(k % 6 == 0, "DirectionalLight").when(k % 6 == 1, "StaticMeshActor").when(k % 6 == 2, "HLODActor").when(k % 6 == 3, "BP_Torch_C").otherwise(F.col("c_mktsegment"))
    label = F.concat(F.when(k % 5 == 0, "SkyDome_").otherwise("Thing_"), _s("c_custkey"))
    light = F.when(k % 6 == 0, F.struct((k % 90).cast("double").alias("intensity"), F.lit(255).alias("red"), (k % 200).cast("int").alias("green"), F.lit(7).alias("blue"), F.lit("Movable").alias("mobility"), (k % 4 == 0).alias("shadows"), F.lit(True).alias("visible"), F.when(k % 12 == 0, (k % 50).cast("double")).alias("radius"), F.lit(None).cast("double").alias("cone")))
    level = _cat("/Game/maps/", F.col("n_name"))
    actor = _cat("Actor", _s("c_custkey"))
    return rows.select(level.alias("level"), actor.alias("actor"), _cat("asset:", level, "::actor::", actor).alias("id"), label.alias("label"), kind.alias("class"), F.when(k % 6 == 3, "/Game/props/BP_Torch").alias("class_package"), F.lit("0,0,0").alias("location"), light.alias("light"), F.when(k % 6 == 1, _cat("/Game/mesh/", F.col("c_mktsegment"))).alias("mesh"), k.alias("k"), "c_mktsegment")


def _detailed(p: Project) -> tuple[DataFrame, DataFrame]:
    actors = _actors(p)
    spare = actors.where("k % 6 > 2").select(F.col("id").alias("owner"), "k", "c_mktsegment")
    size = spare.select("owner", F.lit("Size").alias("prop"), (F.col("k") % 3).cast("string").alias("value"), F.lit("0").alias("default_value"), F.lit(None).cast("string").alias("ref_package"))
    sound = spare.where("k % 4 = 0").select("owner", F.lit("Sound").alias("prop"), F.col("c_mktsegment").alias("value"), F.lit(None).cast("string").alias("default_value"), _cat("/Game/sounds/", F.col("c_mktsegment")).alias("ref_package"))
    return assets.actor_detail(actors, size.unionByName(sound))


_DETAIL = "CASE WHEN k % 6 = 0 THEN 'intensity=' || CAST(k % 90 AS STRING) || ' color=255,' || CAST(k % 200 AS STRING) || ',7 mobility=Movable shadows=' || CASE WHEN k % 4 = 0 THEN 'yes' ELSE 'no' END || ' visible=yes' || CASE WHEN k % 12 = 0 THEN ' radius=' || CAST(k % 50 AS STRING) ELSE '' END WHEN k % 6 = 1 THEN 'mesh=' || m WHEN k % 6 = 2 OR (k % 3 = 0 AND k % 4 > 0) THEN 'engine defaults' ELSE concat_ws(' ', CASE WHEN k % 3 > 0 THEN 'Size=' || CAST(k % 3 AS STRING) END, CASE WHEN k % 4 = 0 THEN 'Sound=' || m END) END"
_ACTOR_ID = "'asset:' || level || '::actor::' || actor"
query("actor_detail", f"WITH {_ACTORS} SELECT {_ACTOR_ID} AS id, {_DETAIL} AS detail FROM a")(lambda p: _detailed(p)[0].select("id", "detail"))
query("actor_references", f"""WITH {_ACTORS} SELECT {_ACTOR_ID} AS src, 'asset:/Game/mesh/' || m AS dst, 'references' AS type, '{{"via":"mesh"}}' AS attrs FROM a WHERE k % 6 = 1 UNION ALL SELECT {_ACTOR_ID}, 'asset:/Game/sounds/' || m, 'references', '{{"via":"Sound"}}' FROM a WHERE k % 6 > 2 AND k % 4 = 0""")(lambda p: _edges(_detailed(p)[1]))
_LOOKS = "g AS (SELECT level, CASE WHEN class = 'DirectionalLight' THEN class WHEN k % 5 = 0 THEN 'SkyDome (' || class || ')' END AS look FROM a WHERE class <> 'HLODActor'), gn AS (SELECT level, look, count(*) AS n FROM g WHERE look IS NOT NULL GROUP BY ALL), looks AS (SELECT * FROM gn QUALIFY row_number() OVER (PARTITION BY level ORDER BY n DESC, look) <= 16)"
query("look_groups", f"WITH {_ACTORS}, {_LOOKS} SELECT level, look, n FROM looks")(lambda p: assets.look_groups(_actors(p)))
_LISTED = "r AS (SELECT *, row_number() OVER (PARTITION BY level, class ORDER BY actor) AS turn, count(*) OVER (PARTITION BY level, class) AS size FROM a WHERE class <> 'HLODActor'), listed AS (SELECT *, CASE WHEN script THEN 'asset:/Game/props/BP_Torch' ELSE 'cpp:' || class END AS target FROM r QUALIFY row_number() OVER (PARTITION BY level ORDER BY turn, size, class, actor) <= 20)"


def _level(p: Project) -> tuple[DataFrame, ...]:
    return assets.level_recipe(_detailed(p)[0], 20)


query("level_entities", f"""WITH {_ACTORS}, {_LISTED} SELECT {_ACTOR_ID} AS id, label AS name, 'asset:' || level AS parent, label || ' (' || class || ')' AS summary, '{{"class":"' || class || '","location":"0,0,0"}}' AS detail FROM listed""")(lambda p: _level(p)[0].select("id", "name", "parent", "summary", "detail"))
query("level_edges", f"""WITH {_ACTORS}, {_LISTED} SELECT DISTINCT 'asset:' || level AS src, CASE WHEN script THEN 'asset:/Game/props/BP_Torch' ELSE 'cpp:' || class END AS dst, 'references' AS type, '{{"via":"places"}}' AS attrs FROM r UNION ALL SELECT {_ACTOR_ID}, 'asset:' || level, 'placed-in-level', '' FROM listed UNION ALL SELECT {_ACTOR_ID}, target, 'instance-of', '' FROM listed""")(lambda p: _edges(_level(p)[1]))
query(
    "level_text",
    f"WITH {_ACTORS}, {_LOOKS}, c AS (SELECT level, name, class, count(*) AS n FROM a GROUP BY ALL), s AS (SELECT level, name, sum(n) AS total, count(*) AS classes, string_agg(class || ' x' || CAST(n AS STRING), ', ' ORDER BY n DESC, class) AS listed FROM c GROUP BY ALL), e AS (SELECT level, string_agg(look || CASE WHEN n > 1 THEN ' x' || CAST(n AS STRING) ELSE '' END, ', ' ORDER BY n DESC, look) AS looks FROM looks GROUP BY level) SELECT 'asset:' || s.level AS id, name || ' (Level)' || chr(10) || 'Actors: ' || CAST(total AS STRING) || ' in ' || CAST(classes AS STRING) || ' classes' || CASE WHEN total > 20 THEN ' (20 listed as entities, round-robin by class — every class represented; all counted below)' ELSE '' END || coalesce(chr(10) || 'Lighting & environment: ' || looks, '') || chr(10) || listed AS text FROM s LEFT JOIN e ON e.level = s.level",
)(lambda p: _level(p)[2])
query("level_chunks", f"WITH {_ACTORS}, {_LISTED} SELECT {_ACTOR_ID} || '#actor' AS id, {_ACTOR_ID} AS entity_id, label || ' (' || class || ' / ' || {CAMEL.format('class')} || ') in ' || name || ' — ' || {_DETAIL} AS text FROM listed")(lambda p: _level(p)[3])


# --- reflection, dispatch, scripts


@query("reflection_text", f"SELECT {ID} AS owner, concat_ws(', ', 'Brand=' || p_brand, 'Price=' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING), CASE WHEN p_size % 2 = 0 THEN 'Size=' || CAST(p_size AS STRING) END) AS text FROM part")
def _reflection(p: Project) -> DataFrame:
    rows = [("Brand", F.col("p_brand")), ("Price", F.col("p_retailprice").cast("decimal(18,2)").cast("string")), ("Size", F.when(F.col("p_size") % 2 == 0, _s("p_size"))), ("Long", F.repeat(F.lit("x"), F.lit(60)))]
    pairs = F.array(*[F.struct(F.lit(name).alias("prop"), value.alias("value")) for name, value in rows])
    return assets.reflection_summary(p.table("part").select(_id().alias("owner"), F.explode(pairs).alias("x")).select("owner", "x.*", F.lit(None).cast("string").alias("ref_package")))


@query("recipe_dispatch", f"SELECT {ID} AS id, CASE WHEN p_size % 4 = 0 OR p_partkey % 3 = 2 THEN 'tags' WHEN p_partkey % 3 = 0 THEN 'StaticMesh' ELSE 'Material' END AS recipe FROM part")
def _dispatch(p: Project) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("StaticMesh", "Material", "SoundCue"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = p.table("part").select(_id().alias("id"), kinds.alias("class"), (F.col("p_size") % 4 == 0).alias("shallow"))
    found = assets.dispatch(rows, {"StaticMesh": None, "Material": None}, F.col("shallow"))
    return assets.union_all([frame.select("id", F.lit(name).alias("recipe")) for name, frame in found.items()])


def _script(p: Project) -> tuple[DataFrame, DataFrame]:
    rows = p.table("supplier").join(p.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    package, key = _cat("/Game/bp/", _s("s_suppkey")), F.col("s_suppkey")
    member = lambda m, name, type, ref: F.struct(F.lit(m).alias("member"), name.alias("name"), F.lit(type).alias("type"), ref.alias("ref"))
    none = F.lit(None).cast("string")
    found = F.array(member("function", _cat("Do", F.col("n_name")), "void", none), member("variable", F.lit("Stock"), "int", none), member("component", F.lit("Body"), "Mesh", none), member("call", none, "", _cat("asset:/Game/bp/", (key + 1).cast("string"), "::Run")), member("call", none, "", _cat("asset:/Game/bp/", (key + 1).cast("string"), "::Run")), member("interface", none, "", F.lit("cpp:Useable")), member("input", none, "", _cat("asset:/Game/input/IA_", F.col("n_name"))))
    return assets.blueprint_structure(rows.select(package.alias("package"), F.explode(found).alias("x")).select("package", "x.*"))


_BP = "'asset:/Game/bp/' || CAST(s_suppkey AS STRING)"
query("script_members", f"""SELECT {_BP} || m.tail || CASE m.name WHEN 'Do' THEN 'Do' || n_name ELSE m.name END AS id, m.kind, {_BP} AS parent, '{{"type":"' || m.type || '"}}' AS detail FROM supplier JOIN nation ON s_nationkey = n_nationkey, (VALUES ('::', 'Do', 'bp-function', 'void'), ('::var::', 'Stock', 'bp-variable', 'int'), ('::comp::', 'Body', 'bp-component', 'Mesh')) m(tail, name, kind, type)""")(lambda p: _script(p)[0].select("id", "kind", "parent", "detail"))
query("script_edges", f"SELECT {_BP} AS src, 'asset:/Game/bp/' || CAST(s_suppkey + 1 AS STRING) || '::Run' AS dst, 'calls' AS type, '' AS attrs FROM supplier UNION ALL SELECT {_BP}, 'cpp:Useable', 'implements', '' FROM supplier UNION ALL SELECT {_BP}, 'asset:/Game/input/IA_' || n_name, 'binds-input', '' FROM supplier JOIN nation ON s_nationkey = n_nationkey")(lambda p: _edges(_script(p)[1]))


# --- JSON values: numbers in several forms, and properties within properties

_SHARE = "CAST(CAST(p_partkey AS DECIMAL(12,0)) * CAST(0.12345671 AS DECIMAL(9,8)) AS {0})"


@query(
    "json_scalars",
    f"""SELECT p_partkey, 'whole' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'big', CAST(CAST(p_size AS BIGINT) * 1000000 AS VARCHAR) FROM part
    UNION ALL SELECT p_partkey, 'share', printf('%g', {_SHARE.format('DOUBLE')}) FROM part UNION ALL SELECT p_partkey, 'tiny', '1.5e-07' FROM part UNION ALL SELECT p_partkey, 'flag', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END FROM part
    UNION ALL SELECT p_partkey, 'name', p_name FROM part""",
)
def _json_scalars(p: Project) -> DataFrame:
    detail = """concat('{"whole":', p_size, '.0,"big":', p_size, 'e6,"share":', %s, ',"tiny":0.00000015,"flag":', p_size %% 2 = 0, ',"name":"', p_name, '","empty":"","none":null,"list":[1],"object":{"a":1}}')"""
    return intent.json_scalars(p.table("part").select("p_partkey", F.expr(detail % _SHARE.format("STRING")).alias("detail")), "detail").select("p_partkey", "key", "value")


def _nested(p: Project) -> tuple[DataFrame, DataFrame]:
    """A part's properties: one of its own, two within a structure, and what is left out (deeper, lists, plumbing)."""
    own = """concat('{"Size":', p_size, ',"Lens":{"Bias":', p_size %% 4, '.5,"Mode":"', p_type, '","Far":{"Out":1},"Cover":"Texture2D\\'/Game/tex/', p_type, '.', p_type, '\\'"},"Tags":{"A":1},"Names":["x"]}')""".replace("%%", "%")
    usual = """concat('{"Size":5,"Lens":{"Bias":2.5,"Mode":"PROMO"}}')"""
    return assets.property_diff(assets.flatten_properties(p.table("part").select(_id().alias("owner"), F.expr(own).alias("props"), F.expr(usual).alias("defaults"))))


query(
    "nested_properties",
    f"""SELECT {ID} AS owner, concat_ws(', ', CASE WHEN p_size % 4 <> 2 THEN 'Lens.Bias=' || CAST(p_size % 4 AS VARCHAR) || '.5' END, 'Lens.Cover=' || p_type, CASE WHEN p_type <> 'PROMO' THEN 'Lens.Mode=' || p_type END, CASE WHEN p_size <> 5 THEN 'Size=' || CAST(p_size AS VARCHAR) END) AS text FROM part""",
)(lambda p: _nested(p)[0])
query("nested_references", f"""SELECT {ID} AS src, 'asset:/Game/tex/' || p_type AS dst, 'references' AS type, '{{"via":"Cover"}}' AS attrs FROM part""")(lambda p: _edges(_nested(p)[1]))


# Notes state a part's values in words; its detail has them as 3.0, 1e6 and with eight digits.
@query(
    "drift_six_digits",
    f"""WITH a AS (SELECT p_partkey, {_SHARE.format('DOUBLE')} AS share, {_SHARE.format('VARCHAR')} AS stated FROM part),
    s AS (SELECT *, printf('%g', share) AS actual FROM a)
    SELECT 'doc:' || CAST(p_partkey AS VARCHAR) AS src, {ID} AS dst, 'share' AS key, stated, actual FROM s WHERE abs(CAST(stated AS DOUBLE) - CAST(actual AS DOUBLE)) > 1e-6
    UNION ALL SELECT 'doc:' || CAST(p_partkey AS VARCHAR), {ID}, 'whole', CAST(p_size + 1 AS VARCHAR), CAST(p_size AS VARCHAR) FROM part WHERE p_size % 3 = 0""",
)
def _drift_six(p: Project) -> DataFrame:
    part = p.table("part")
    detail = """concat('{"whole":', p_size, '.0,"large":', p_size, 'e6,"share":', %s, '}')""" % _SHARE.format("STRING")
    told = """concat('Its whole = ', p_size + if(p_size %% 3 = 0, 1, 0), ', large: ', p_size, '000000 and share = ', %s, ' .')""" % _SHARE.format("STRING")
    entities = part.select(_id().alias("id"), F.expr(detail).alias("detail"))
    chunks = part.select(F.concat(F.lit("c"), _s("p_partkey")).alias("id"), F.concat(F.lit("doc:"), _s("p_partkey")).alias("entity_id"), F.lit("doc-section").alias("kind"), F.expr(told).alias("text"))
    edges = part.select(F.concat(F.lit("doc:"), _s("p_partkey")).alias("src"), _id().alias("dst"), F.lit("describes").alias("type"))
    return intent.drift(entities, edges, chunks, None, True)
