"""Asset and script extractors over tabular inputs: entities, edges and summary texts by rule."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dimensions, one_line, package_of
from ..schema import edge, entity
from .intent import scalar_text

PRODUCER = "registry@1"
# Tags of bookkeeping, and classes whose summary needs the asset itself.
SKIPPED_TAGS = ("FiBData", "AssetImportData", "PrimaryAssetType", "PrimaryAssetName")
MOST_TAGS, TAG_CHARS, MOST_PROPERTIES, PROPERTY_CHARS, MOST_ALL, ALL_CHARS = 12, 96, 28, 80, 40, 60
# Words of actor classes and labels that make the look of a level.
LOOK = "light|sky|fog|postprocess|cloud|atmosphere|weather|lumen"
MOST_LOOKS, MOST_ACTORS = 16, 500


def registry(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of an inventory (package, name, class, tags, deps): packages below /Game; dependencies within
    /Game; a blueprint inherits its native parent class."""
    own = assets.where(F.col("package") .startswith("/Game"))
    id = F.concat(F.lit("asset:"), F.col("package"))
    blueprint = F.col("class").contains("Blueprint")
    rows = own.select(*entity(id, "asset", F.col("name"), F.col("package"), "asset", detail=F.to_json(F.struct(F.col("class").alias("assetClass"))), producer=PRODUCER), blueprint.alias("b"))
    entities = rows.withColumn("kind", F.when(F.col("b"), "blueprint").otherwise(F.col("kind"))).drop("b")
    deps = own.select(id.alias("src"), F.explode("deps").alias("dep")).where(F.col("dep").startswith("/Game")).select(*edge(F.col("src"), F.concat(F.lit("asset:"), F.col("dep")), "depends-on", producer=PRODUCER))
    native = F.regexp_extract(F.col("tags")["NativeParentClass"], r"([A-Za-z_]\w*)'?\"?$", 1)
    parents = own.where(blueprint & (native != "")).select(*edge(id, F.concat(F.lit("cpp:"), native), "inherits", producer=PRODUCER))
    return entities, deps.unionByName(parents).distinct()


def tag_rows(assets: DataFrame) -> DataFrame:
    """id, key, value, package, place of the tags that tell something: MOST_TAGS of an asset by key, short values only."""
    tags = assets.select(F.concat(F.lit("asset:"), F.col("package")).alias("id"), F.explode("tags").alias("key", "value"))
    kept = tags.where(~F.col("key").isin(*SKIPPED_TAGS) & ~F.startswith("key", F.lit("Blueprint")) & (F.col("value") != "") & (F.length("value") <= TAG_CHARS))
    place = F.row_number().over(Window.partitionBy("id").orderBy("key"))
    return kept.withColumn("place", place).where(F.col("place") <= MOST_TAGS).withColumn("package", package_of(F.col("value")))


def tag_summary(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary texts (id, text) and edges of assets by their tags alone; a tag that names a package is a reference."""
    rows = tag_rows(assets)
    line = F.concat_ws("=", F.col("key"), F.coalesce(F.element_at(F.split("package", "/"), -1), F.col("value")))
    texts = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), ", ").alias("text"))
    kind = F.when(F.col("key") == "Skeleton", "uses-skeleton").otherwise("references")
    edges = rows.where(F.col("package").isNotNull()).select(*edge(F.col("id"), F.concat(F.lit("asset:"), F.col("package")), kind, F.col("key"), PRODUCER)).distinct()
    return texts, edges


def property_diff(properties: DataFrame, most: int = MOST_PROPERTIES, chars: int = PROPERTY_CHARS, separator: str = ", ") -> tuple[DataFrame, DataFrame]:
    """Texts (owner, text) of the properties (owner, prop, value, default_value, ref_package) that differ from their
    defaults, and the references among them."""
    changed = properties.where(~F.col("value").eqNullSafe(F.col("default_value")) & F.col("value").isNotNull() & (F.length("value") < chars))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("prop"))
    kept = changed.withColumn("place", place).where(F.col("place") <= most)
    texts = kept.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("=", "prop", "value").alias("x")))), lambda x: x["x"]), separator).alias("text"))
    via = F.substring_index("prop", ".", -1)
    edges = kept.where(F.col("ref_package").startswith("/Game")).select(*edge(F.col("owner"), F.concat(F.lit("asset:"), F.col("ref_package")), "references", via)).distinct()
    return texts, edges


# Properties that differ on every placed object and tell nothing about it.
PLUMBING = ("RelativeLocation", "RelativeRotation", "RelativeScale3D", "RootComponent", "AttachParent", "AttachSocketName", "BodyInstance", "ComponentTags", "Tags", "AssetImportData", "BlueprintCreatedComponents", "InstanceComponents")


def _leaves(objects: DataFrame, column: str) -> DataFrame:
    """owner, prop, value of the scalars of a JSON object of properties, and of those within its objects, as Outer.Inner."""
    tvf = objects.sparkSession.tvf
    parsed = objects.select("owner", F.try_parse_json(column).alias("o")).where(F.schema_of_variant("o").startswith("OBJECT"))
    top = parsed.lateralJoin(tvf.variant_explode(F.col("o").outer())).select("owner", "key", "value").where(~F.col("key").isin(*PLUMBING))
    inner = top.where(F.schema_of_variant("value").startswith("OBJECT")).select("owner", F.col("key").alias("outside"), F.col("value").alias("o"))
    inner = inner.lateralJoin(tvf.variant_explode(F.col("o").outer())).where(~F.col("key").isin(*PLUMBING))
    both = top.select("owner", F.col("key").alias("prop"), "value").unionByName(inner.select("owner", F.concat_ws(".", "outside", "key").alias("prop"), "value"))
    return both.select("owner", "prop", one_line(scalar_text(F.col("value"))).alias("value")).where("value <> ''")


def flatten_properties(objects: DataFrame) -> DataFrame:
    """Rows for property_diff() (owner, prop, value, default_value, ref_package) of objects whose properties and defaults are
    JSON texts (owner, props, defaults): one level of structures is opened, deeper ones and arrays are left out, and a value
    that names a package of the project is told by its last name. JSON costs much for its bytes, so rows are dealt out before
    it is read: a small file is one task otherwise."""
    objects = objects.repartition("owner")
    own, usual = _leaves(objects, "props"), _leaves(objects, "defaults").withColumnRenamed("value", "default_value")
    named = own.join(usual, ["owner", "prop"], "left").withColumn("ref_package", package_of(F.col("value")))
    told = lambda c: F.coalesce(_last(package_of(F.col(c))), F.col(c)).alias(c)
    return named.select("owner", "prop", told("value"), told("default_value"), "ref_package")


def reflection_summary(properties: DataFrame) -> DataFrame:
    """Texts (owner, text) of all properties, for classes without a recipe."""
    return property_diff(properties.withColumn("default_value", F.lit(None).cast("string")), MOST_ALL, ALL_CHARS)[0]


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _asset(path: Column) -> Column:
    return F.concat(F.lit("asset:"), path)


# The words, marks and order of what the summaries below say of an asset, an actor and a level, which readers
# of an index know: "Triangles(LOD0)", "Material slots", "TwoSided", "mobility=", "Lighting & environment", the note on
# actors that are counted but not listed, and so on.


def texture_text(name: Column, tags: Column) -> Column:
    """The summary of a texture that isn't loaded, from its tags; null without dimensions."""
    size = dimensions(tags["Dimensions"])
    return F.when(size.isNotNull(), F.concat(name, F.lit(" (Texture2D)\n"), size["width"].cast("string"), F.lit("x"), size["height"].cast("string")))


def mesh_recipe(meshes: DataFrame, skeletal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts (id, text) and edges of meshes (id, name, lods, materials array<string>, and triangles or skeleton)."""
    listed = F.concat(F.lit("\nMaterials: "), F.array_join(F.transform("materials", _last), ", "))
    lods, slots = F.col("lods").cast("string"), F.size("materials").cast("string")
    if skeletal:
        facts = F.concat(F.lit(" (SkeletalMesh)\nSkeleton: "), F.coalesce(_last(F.col("skeleton")), F.lit("none")), F.lit(", LODs: "), lods, F.lit(", Material slots: "), slots)
    else:
        facts = F.concat(F.lit(" (StaticMesh)\nLODs: "), lods, F.lit(", Triangles(LOD0): "), F.col("triangles").cast("string"), F.lit(", Material slots: "), slots)
    edges = meshes.select("id", F.explode("materials").alias("m")).select(*edge(F.col("id"), _asset(F.col("m")), "uses-material"))
    if skeletal:
        edges = edges.unionByName(meshes.where("skeleton is not null").select(*edge(F.col("id"), _asset(F.col("skeleton")), "uses-skeleton")))
    return meshes.select("id", F.concat("name", facts, listed).alias("text")), edges.distinct()


def material_recipe(materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts and edges of materials (id, name, parent, blend, two_sided, textures array<struct<param,texture>>). One with a
    parent is an instance: its textures are overridden parameters, which are named."""
    instance = F.col("parent").isNotNull()
    named = F.transform("textures", lambda t: F.when(instance, F.concat_ws("=", t["param"], _last(t["texture"]))).otherwise(_last(t["texture"])))
    head = F.concat("name", F.when(instance, F.concat(F.lit(" (MaterialInstance)\nParent: "), _last(F.col("parent")), F.lit("\n"))).otherwise(" (Material)\n"))
    facts = F.concat(F.lit("Blend: "), F.col("blend"), F.lit(", TwoSided: "), F.when(F.col("two_sided"), "yes").otherwise("no"), F.lit(", Textures: "), F.size("textures").cast("string"), F.lit("\n"), F.array_join(named, ", "))
    each = materials.select("id", instance.alias("i"), F.explode("textures").alias("t"))
    used = each.where("i").select(*edge(F.col("id"), _asset(F.col("t.texture")), "uses-texture", F.col("t.param"))).unionByName(each.where("not i").select(*edge(F.col("id"), _asset(F.col("t.texture")), "uses-texture")))
    parents = materials.where(instance).select(*edge(F.col("id"), _asset(F.col("parent")), "references", F.lit("parent")))
    return materials.select("id", F.concat(head, facts).alias("text")), used.unionByName(parents).distinct()


def input_context_recipe(mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts and edges of input mappings (id, name, seq, action, key, modifiers array, triggers array) in order of seq: a
    line `action <- key [modifiers] (triggers)` each, with the classes' common prefixes left out."""

    def short(classes: str, prefix: str, left: str, right: str) -> Column:
        names = F.array_join(F.transform(classes, lambda c: F.regexp_replace(c, f"^{prefix}", "")), ",")
        return F.when(names == "", "").otherwise(F.concat(F.lit(f" {left}"), names, F.lit(right)))

    line = F.concat(F.coalesce(_last(F.col("action")), F.lit("<none>")), F.lit(" <- "), F.col("key"), short("modifiers", "InputModifier", "[", "]"), short("triggers", "InputTrigger", "(", ")"))
    lines = mappings.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    texts = lines.select("id", F.concat("name", F.lit(" (InputMappingContext)\nMappings ("), F.size("l").cast("string"), F.lit("):\n"), F.array_join(F.col("l.line"), "\n")).alias("text"))
    return texts, mappings.where("action is not null").select(*edge(F.col("id"), _asset(F.col("action")), "references", F.lit("maps"))).distinct()


def simple_recipe(rows: DataFrame) -> DataFrame:
    """Texts of skeletons (bones), data tables (row_struct, n_rows) and input actions (value_type): id, name, class and those."""
    number = lambda c: F.col(c).cast("string")
    told = (
        F.when(F.col("class") == "Skeleton", F.concat(F.lit("Bones: "), number("bones")))
        .when(F.col("class") == "DataTable", F.concat(F.lit("Row struct: "), F.coalesce("row_struct", F.lit("none")), F.lit(", Rows: "), number("n_rows")))
        .when(F.col("class") == "InputAction", F.concat(F.lit("ValueType: "), F.col("value_type")))
    )
    return rows.where(told.isNotNull()).select("id", F.concat("name", F.lit(" ("), "class", F.lit(")\n"), told).alias("text"))


def actor_detail(actors: DataFrame, properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """actors (id, light struct, mesh) with detail (one line) and the edges of what it names. A light tells its settings,
    a mesh actor its mesh; others tell the properties that differ from their defaults, or that all are defaults."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    light, yes = F.col("light"), lambda c: F.when(c, "yes").otherwise("no")
    extra = F.concat(*[F.when(light[f].isNotNull(), F.concat(F.lit(f" {name}="), whole(light[f]))).otherwise("") for f, name in (("radius", "radius"), ("cone", "cone"))])
    colour = F.concat_ws(",", *[light[c].cast("string") for c in ("red", "green", "blue")])
    lit = F.concat(F.lit("intensity="), whole(light["intensity"]), F.lit(" color="), colour, F.lit(" mobility="), light["mobility"], F.lit(" shadows="), yes(light["shadows"]), F.lit(" visible="), yes(light["visible"]), extra)
    plain = actors.where("light is null and mesh is null")
    texts, references = property_diff(properties.join(plain.select(F.col("id").alias("owner")), "owner", "left_semi"), separator=" ")
    told = actors.join(texts.select(F.col("owner").alias("id"), F.col("text").alias("_diff")), "id", "left")
    detail = F.when(light.isNotNull(), lit).when(F.col("mesh").isNotNull(), F.concat(F.lit("mesh="), _last(F.col("mesh")))).otherwise(F.coalesce("_diff", F.lit("engine defaults")))
    meshes = actors.where("light is null and mesh is not null").select(*edge(F.col("id"), _asset(F.col("mesh")), "references", F.lit("mesh")))
    return told.select(*actors.columns, detail.alias("detail")), meshes.unionByName(references).distinct()


def look_groups(actors: DataFrame, most: int = MOST_LOOKS) -> DataFrame:
    """level, look, n: listed actors (level, label, class) by class if that makes the look of a level, else by label without
    its number (and class) if that does; the `most` largest groups of a level, ties by name."""
    from .stats import DERIVED

    label = F.regexp_replace("label", "[0-9_]+$", "")
    look = F.when(F.lower("class").rlike(LOOK), F.col("class")).when(F.lower(label).rlike(LOOK), F.concat(label, F.lit(" ("), F.col("class"), F.lit(")")))
    counts = actors.where(~F.col("class").isin(*DERIVED)).select("level", look.alias("look")).where("look is not null").groupBy("level", "look").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("n"), "look"))
    return counts.withColumn("place", place).where(F.col("place") <= most).drop("place")


def class_target(actors: DataFrame) -> Column:
    """The id of an actor's class: the script package that generated it, else the C++ class."""
    return F.when(F.col("class_package").isNotNull(), _asset(F.col("class_package"))).otherwise(F.concat(F.lit("cpp:"), F.col("class")))


def level_recipe(actors: DataFrame, limit: int = MOST_ACTORS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of actors (level, actor, label, class, class_package, location, detail): entities of the listed ones, edges, the
    levels' summaries and the actors' chunks (id, entity_id, text).

    A level has one `places` reference to each class; a listed actor is placed in its level and an instance of its class."""
    from ..functions.text import split_camel
    from .stats import DERIVED, class_histogram, select_actors

    level, name = _asset(F.col("level")), _last(F.col("level"))
    id = F.concat(level, F.lit("::actor::"), F.col("actor"))
    listed = select_actors(actors, limit).select("level", "actor").join(actors, ["level", "actor"])
    told = F.concat(F.col("label"), F.lit(" ("), F.col("class"), F.lit(")"))
    entities = listed.select(*entity(id, "level-actor", F.col("label"), name, "asset", level, told, F.to_json(F.struct("class", "location"))))
    places = actors.where(~F.col("class").isin(*DERIVED)).select("level", "class", "class_package").distinct().select(*edge(level, class_target(actors), "references", F.lit("places")))
    edges = places.unionByName(listed.select(*edge(id, level, "placed-in-level"))).unionByName(listed.select(*edge(id, class_target(listed), "instance-of"))).distinct()
    tail = F.when(F.coalesce("detail", F.lit("")) == "", "").otherwise(F.concat(F.lit(" — "), F.col("detail")))
    chunks = listed.select(F.concat(id, F.lit("#actor")).alias("id"), id.alias("entity_id"), F.concat("label", F.lit(" ("), "class", F.lit(" / "), split_camel(F.col("class")), F.lit(") in "), name, tail).alias("text"))

    def joined(groups: DataFrame, column: str, text: Column) -> DataFrame:
        order = F.struct((-F.col("n")).alias("o"), F.col(column).alias("c"), text.alias("t"))
        return groups.groupBy("level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), ", ").alias("listed"), F.sum("n").alias("total"), F.count("*").alias("groups"))

    times = lambda c: F.concat(F.col(c), F.lit(" x"), F.col("n").cast("string"))
    counts = joined(class_histogram(actors), "class", times("class"))
    looks = joined(look_groups(actors), "look", F.when(F.col("n") > 1, times("look")).otherwise(F.col("look"))).select("level", F.col("listed").alias("looks"))
    capped = F.when(F.col("total") > limit, f" ({limit} listed as entities, round-robin by class — every class represented; all counted below)").otherwise("")
    look = F.when(F.col("looks").isNotNull(), F.concat(F.lit("\nLighting & environment: "), F.col("looks"))).otherwise("")
    text = F.concat(name, F.lit(" (Level)\nActors: "), F.col("total").cast("string"), F.lit(" in "), F.col("groups").cast("string"), F.lit(" classes"), capped, look, F.lit("\n"), F.col("listed"))
    return entities, edges, counts.join(looks, "level", "left").select(level.alias("id"), text.alias("text")), chunks


MOST_OUTPUT, MOST_INDENT, MOST_INLINE, MOST_FLAT = 16_000, 40, 3, 400


def render(nodes: list[tuple], pins: list[tuple]) -> str:
    """Pseudo-code of one graph. nodes: (node, title, is_event, seq); pins: (node, pin, dir, is_exec, linked, default, seq).

    Runs from events (else from nodes that only send execution) depth-first; a node seen before is named, not repeated;
    several ways out are labelled; data of nodes without execution is written in place. Graphs without execution are a list."""
    title = {n[0]: n[1] for n in nodes}
    order = {n[0]: (n[3], n[0]) for n in nodes}
    by: dict[str, list] = {n[0]: [] for n in nodes}
    for p in sorted(pins, key=lambda p: (p[6], p[1])):
        by.setdefault(p[0], []).append(p)
    sends = {n: [p for p in by[n] if p[2] == "out" and p[3]] for n in by}
    takes = {n: [p for p in by[n] if p[2] == "in" and p[3]] for n in by}
    if not any(sends.values()):
        return "\n".join(title[n] for n in sorted(title, key=order.get)[:MOST_FLAT])

    def data(node: str, depth: int) -> str:
        parts = []
        for p in by.get(node, []):
            if p[2] == "in" and not p[3]:
                if p[4] and p[4] in title:
                    other = p[4]
                    pure = not sends.get(other) and not takes.get(other)
                    parts.append(f"{p[1]}={title[other]}{data(other, depth + 1)}" if pure and depth < MOST_INLINE else f"{p[1]}={title[other]}")
                elif p[5]:
                    parts.append(f"{p[1]}={p[5]}")
        return f"({', '.join(parts)})" if parts else ""

    roots = [n for n in title if any(x[0] == n and x[2] for x in nodes)] or [n for n in title if sends.get(n) and not takes.get(n)]
    lines, seen = [], set()
    size = 0
    work = [(n, 0, "") for n in sorted(roots, key=order.get, reverse=True)]
    while work and size < MOST_OUTPUT:
        node, indent, label = work.pop()
        pad = "  " * min(indent, MOST_INDENT)
        if label:
            lines.append(f"{pad}[{label}]")
            size += len(lines[-1]) + 1
        text = f"{pad}{title.get(node, node)}{' (see above)' if node in seen else data(node, 0)}"
        lines.append(text)
        size += len(text) + 1
        if node in seen:
            continue
        seen.add(node)
        out = [p for p in sends.get(node, []) if p[4] in title]
        many = len(sends.get(node, [])) > 1
        for p in reversed(out):
            work.append((p[4], indent + 1 if many or indent == 0 else indent, p[1] if many else ""))
    return "\n".join(lines)[:MOST_OUTPUT]


def render_graphs(nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """graph, text of graphs (nodes: graph, node, title, is_event, seq; pins: graph, node, pin, dir, is_exec, linked_node,
    default_value, seq). A graph is one group, as its order is a walk; graphs are documents of a bounded size."""

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = list(zip(*(left.column(c).to_pylist() for c in ("node", "title", "is_event", "seq"))))
        wires = list(zip(*(right.column(c).to_pylist() for c in ("node", "pin", "dir", "is_exec", "linked_node", "default_value", "seq"))))
        return pa.table({"graph": [key[0].as_py()], "text": [render(own, wires)]})

    return nodes.groupBy("graph").cogroup(pins.groupBy("graph")).applyInArrow(one, "graph string, text string")


def blueprint_structure(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of script members (package, member, name, type, ref, and value where defaults are known):
    functions, variables and components are children; calls, references, implements and binds-input come from `ref`."""
    members = members if "value" in members.columns else members.withColumn("value", F.lit(None).cast("string"))
    id = F.concat(F.lit("asset:"), F.col("package"))
    part = {"function": "::", "variable": "::var::", "component": "::comp::"}
    rows = [members.where(F.col("member") == m).select(*entity(F.concat(id, F.lit(sep), F.col("name")), f"bp-{m}", F.col("name"), F.col("package"), "asset", id, detail=F.to_json(F.struct("type", F.col("value").alias("default"))))) for m, sep in part.items()]
    kinds = {"call": "calls", "reference": "references", "interface": "implements", "input": "binds-input"}
    edges = [members.where(F.col("member") == m).select(*edge(id, F.col("ref"), t)) for m, t in kinds.items()]
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, edges).distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dispatch(assets: DataFrame, recipes: dict, shallow: Column | None = None) -> dict[str, DataFrame]:
    """assets by the recipe of their class; shallow ones and classes without a recipe go to `tags`."""
    known = F.col("class").isin(*recipes) & ~(shallow if shallow is not None else F.lit(False))
    return {**{c: assets.where(known & (F.col("class") == c)) for c in recipes}, "tags": assets.where(~known)}



