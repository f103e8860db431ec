"""The behaviour that the index promises, on small rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.functions import text
from lodestone.operators import code, graph, intent, search, stats, store
from lodestone.operators.store import Conflict, Snapshot, Store
from lodestone.schema import CHUNKS, EDGES, ENTITIES, validate


def tables(spark, entities=(), edges=(), chunks=(), producer=None):
    e = [(id, kind, name, "/Game/Test", parent, "asset", None, detail, producer, None) for id, kind, name, parent, detail in entities]
    g = [(*row, None, producer) for row in edges]
    c = spark.createDataFrame([(id, of, "doc-section" if of.startswith("doc:") else "recipe-summary", body, None, producer) for id, of, body in chunks], CHUNKS)
    c = c.withColumn("aux", text.aux_tokens(F.col("entity_id"), F.col("text")))
    return Snapshot(spark.createDataFrame(e, ENTITIES), spark.createDataFrame(g, EDGES), validate(c, "chunks"))


def found(state, query, **options):
    return search.search(search.Index.build(state.chunks, True), state.entities, state.edges, state.chunks, query, **options).collect()


def test_text_utilities(spark):
    row = spark.range(1).select(
        text.split_camel(F.lit("DirectionalLight")).alias("a"), text.split_camel(F.lit("HUDWidget")).alias("b"),
        text.aux_tokens(F.lit("asset:/Game/BP_PlayerCharacter"), F.lit("plain\nBP_Other")).alias("c"),
        text.slug(F.lit(" Hello, World_x ")).alias("d"), text.slug(F.lit("!!")).alias("e"),
        text.is_distinctive(F.lit("BP_X1")).alias("f"), text.is_distinctive(F.lit("Player")).alias("g"), text.is_distinctive(F.lit("PlayerStart")).alias("h"),
        text.package_of(F.lit("Skeleton'/Game/A/B.B'")).alias("i"), text.package_of(F.lit("/Engine/X")).alias("j"),
        text.dimensions(F.lit("64X32")).alias("k"), text.reflection_name(F.lit("AWeapon")).alias("l"), text.reflection_name(F.lit("Actor")).alias("m"),
        text.inner_type(F.lit("TArray<AWeapon*>")).alias("n"), text.inner_type(F.lit("const AWeapon *")).alias("o"),
    ).first()
    assert row["a"] == "Directional Light" and row["b"] == "HUDWidget"
    assert row["c"] == "BP Player Character" and row["d"] == "hello-world-x" and row["e"] == "section"
    assert (row["f"], row["g"], row["h"]) == (True, False, True)
    assert (row["i"], row["j"]) == ("/Game/A/B", None)
    assert tuple(row["k"]) == (64, 32) and (row["l"], row["m"], row["n"], row["o"]) == ("Weapon", "Actor", "AWeapon", "AWeapon")
    assert text.match_expression('a "b" c*', "OR", True) == '"a"* OR "b"* OR "c"*' and text.match_expression(" *") == ""


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "reloading": "reload", "relational": "relat", "hopping": "hop", "falling": "fall", "happy": "happi", "generalizations": "gener", "oscillators": "oscil", "controlling": "control"}
    assert {w: search.stem(w) for w in pairs} == pairs


def test_ingest_twice_and_search(spark):
    new = tables(spark, [("asset:/Game/BP_PlayerCharacter", "blueprint", "BP_PlayerCharacter", None, None), ("v", "bp-variable", "Ammo", "asset:/Game/BP_PlayerCharacter", None)], [("asset:/Game/BP_PlayerCharacter", "cpp:X", "inherits")], [("c1", "asset:/Game/BP_PlayerCharacter", "Handles reloading"), ("c2", "v", "ammo of asset:/Game/BP_PlayerCharacter")])
    empty = tables(spark)
    once = store.ingest_producer(empty, "p", new)
    twice = store.ingest_producer(once, "p", new)
    assert [getattr(twice, t).count() for t in ("entities", "edges", "chunks")] == [2, 1, 2]
    assert len(found(twice, "reload")) == 1 and len(found(twice, "player")) == 2 and found(twice, "...") == []


def test_patch_keeps_other_producers(spark):
    state = store.ingest_producer(tables(spark), "registry", tables(spark, [("a", "asset", "A", None, None)], [("a", "b", "depends-on")]))
    state = store.ingest_producer(state, "assets", tables(spark, [("a::x", "bp-variable", "X", "a", None)], [("a::x", "s", "uses-skeleton")], [("c", "a::x", "old words")]))
    roots = spark.createDataFrame([("a",)], "id string")
    scoped = store.patch_scoped(state, tables(spark, chunks=[("c9", "a", "new words")]), "assets", roots)
    assert {r["id"] for r in scoped.entities.collect()} == {"a"} and {r["type"] for r in scoped.edges.collect()} == {"depends-on"} and [r["id"] for r in scoped.chunks.collect()] == ["c9"]
    full = store.patch(state, tables(spark), "assets", roots)
    assert full.entities.count() == 0 and full.chunks.count() == 0
    assert store.apply_extract(state, "assets", tables(spark), "delta") is state


def test_ranking_demotion_references_and_diversity(spark):
    state = tables(spark, [("l", "level-actor", "Lamp", None, None), ("a", "asset", "Torch", None, None), ("z", "asset", "Other", None, None)], [], [("c1", "l", "flame flame flame flame"), ("c2", "a", "a flame in the hall"), ("c3", "z", "nothing here at all")])
    assert [r["id"] for r in found(state, "flame")] == ["a", "l"]
    twins = tables(spark, [("x", "asset", "X", None, None), ("y", "asset", "Y", None, None), ("o", "asset", "O", None, None), ("q", "asset", "Q", None, None), ("w", "asset", "W", None, None)], [(f"b{i}", "y", "binds-input") for i in range(8)], [("c1", "x", "mapping keys"), ("c2", "y", "mapping keys"), ("c3", "o", "other"), ("c4", "q", "words"), ("c5", "w", "more")])
    hits = found(twins, "mapping")
    assert [r["id"] for r in hits] == ["y", "x"] and hits[0]["inbound"] == 8
    many = spark.createDataFrame([(f"l{i}", "level-actor", "L", -9.0 + i / 10) for i in range(10)] + [("b", "blueprint", "B", -1.0)], "id string, kind string, name string, score double")
    seeds = search.diverse_seeds(many, 6).collect()
    assert "b" in {r["id"] for r in seeds} and len(seeds) == 6


def test_children_in_turns(spark):
    actors = [(f"m::{i}", "level-actor", f"n{i}", "m", '{"class":"%s"}' % c) for i, c in enumerate(["StaticMesh"] * 5 + ["PointLight", "Fog"])]
    e = tables(spark, [("m", "asset", "Map", None, None), *actors]).entities
    first = graph.children(e, "m", limit=3).collect()
    assert len({r["class"] for r in first}) == 3 and first[0]["total"] == 7
    assert {r["class"]: r["n"] for r in graph.children_by_class(e, "m").collect()} == {"StaticMesh": 5, "PointLight": 1, "Fog": 1}
    assert [r["class"] for r in graph.children(e, "m", "light").collect()] == ["PointLight"]
    assert len(graph.children(e, "m", limit=5, offset=5).collect()) == 2


def test_walks(spark):
    e = tables(spark, [(x, "asset", x, None, None) for x in "abcd"]).entities
    g = spark.createDataFrame([("a", "b", "calls"), ("b", "ghost", "uses"), ("ghost", "c", "calls"), ("c", "a", "calls"), ("a", "c", "z"), ("d", "a", "inherits")], "src string, dst string, type string")
    rows = graph.references(e, g, "a", "out", 3).collect()
    assert [(r["id"], r["depth"], r["via"]) for r in rows] == [("b", 1, "calls"), ("c", 1, "z")]
    both = graph.references(e, g, "a", "", 1).collect()
    assert [(r["id"], r["direction"]) for r in both] == [("c", "in"), ("d", "in"), ("b", "out")]
    assert graph.references(e, g, "a", "sideways").count() == 0 and graph.references(e, g, "none").count() == 0
    hurt = graph.impact(e, g, "a").collect()
    assert [(r["id"], r["depth"], r["severity"]) for r in hurt] == [("d", 1, 10.0), ("c", 1, 8.0), ("b", 3, 1 / 3)] or hurt[0]["id"] == "d"
    assert {r["id"] for r in graph.subtree(tables(spark, [("r", "x", "r", "s", None), ("s", "x", "s", "r", None)]).entities, spark.createDataFrame([("r",)], "id string")).collect()} == {"r", "s"}


def test_stats_and_health(spark):
    state = tables(spark, [("m", "asset", "Map", None, None)], [], [("c", "m", "Map (Level) has Actors: 3"), ("o", "gone", "x")])
    checks = {r["check"]: (r["n"], r["ok"]) for r in stats.doctor(state.entities, state.edges, state.chunks).collect()}
    assert checks["levels-without-actors"] == (1, False) and checks["chunks-without-entity"] == (1, False) and checks["entities"] == (1, True)
    assert stats.project_stats(state.entities, state.edges, "no such facet").where("part = 'total'").first()["n"] == 1


def test_drift_and_links(spark):
    state = tables(spark, [("asset:/Game/Gun", "asset", "BigGun_A", None, '{"damage": 10, "speed": "fast", "tags": [1]}'), ("doc:a", "document", "A", None, None)], [("doc:a", "asset:/Game/Gun", "describes")], [("c", "doc:a", "BigGun_A has Damage = 12 and speed: FAST, see asset:/Game/Gun and asset:/Game/None.")])
    rows = intent.drift(state.entities, state.edges, state.chunks).collect()
    assert [(r["key"], r["stated"], r["actual"]) for r in rows] == [("damage", "12", "10")]
    assert [(r["src"], r["dst"]) for r in intent.explicit_links(state.entities, state.chunks).collect()] == [("doc:a", "asset:/Game/Gun")]
    assert [r["attrs"] for r in intent.inferred_links(state.entities, state.chunks).collect()] == ['{"confidence":"inferred","via":"BigGun_A"}']


def test_code(spark):
    header = "UCLASS()\nclass H_API ALighthouse2 : public ATower { UPROPERTY() ALantern* Lantern; UFUNCTION() void Signal(); };\nUCLASS() class ATower : public AStructure { UFUNCTION() void Inspect(); };\nUCLASS() class ALantern : public AStructure { UFUNCTION() void Ignite(); };"
    source = 'void ALighthouse2::Dusk(ALantern* Spare, int32 N)\n{ /* Ignite() */ const char* s = "Inspect()"; Signal(); Super::Inspect(); Lantern->Ignite(); Stranger->Ignite(); Keeper()->Signal(); }\nvoid ALighthouse2::Dawn(ALantern* Spare) { Spare->Ignite(); bool b = N ? ALighthouse2::Signal(1) : false; }\nALighthouse2::ALighthouse2() : Super(1) { }'
    declared = code.classes(spark.createDataFrame([("h", header)], "file string, text string"))
    defined = code.bodies(spark.createDataFrame([("s", source)], "file string, text string"), ["ALighthouse2"])
    assert sorted(r["function"] for r in defined.collect()) == ["ALighthouse2", "Dawn", "Dusk"]
    assert {(r["src"], r["dst"]) for r in code.calls(defined, declared).collect()} == {("Lighthouse2::Dusk", "Lighthouse2::Signal"), ("Lighthouse2::Dusk", "Tower::Inspect"), ("Lighthouse2::Dusk", "Lantern::Ignite"), ("Lighthouse2::Dawn", "Lantern::Ignite"), ("Lighthouse2::Dawn", "Lighthouse2::Signal")}


def test_store_versions(spark, tmp_path):
    home = Store(spark, "file://" + str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        home.open()
    assert not (tmp_path / "store").exists()  # opening writes nothing
    home.create()
    with pytest.raises(ValueError):
        home.verify()
    first = home.generation
    home.ingest("p", tables(spark, [("a", "asset", "A", None, None)], [], [("c", "a", "hello there")]))
    held = home.open()
    home.ingest("q", tables(spark, [("b", "asset", "B", None, None)]))
    assert home.verify() == {"entities": 2, "edges": 0, "chunks": 1} and held.entities.count() == 1 and home.generation == first != ""
    home.ingest("p", tables(spark))
    assert {r["id"] for r in home.open().entities.collect()} == {"b"}
    assert '"id": "b"' in Engine.open(home).envelope(Engine.open(home).get_entity("b"), "b").replace('":"', '": "')


def test_store_survives_crashes_and_second_writers(spark, tmp_path, monkeypatch):
    home = Store(spark, "file://" + str(tmp_path / "store"))
    home.create()
    home.ingest("p", tables(spark, [("a", "asset", "A", None, None)]))
    old = home.ingest("q", tables(spark, [("b", "asset", "B", None, None)]))
    kept = home.meta()["tables"]["entities"]['"q"']
    with monkeypatch.context() as m:
        m.setattr(Store, "_name", lambda *a: (_ for _ in ()).throw(OSError("crash before the pointer")))
        with pytest.raises(OSError):
            home.ingest("p", tables(spark, [("c", "asset", "C", None, None)]))
    assert {r["id"] for r in home.open().entities.collect()} == {"a", "b"}
    base = home.meta()
    home.ingest("p", tables(spark, [("d", "asset", "D", None, None)]))
    assert home.meta()["tables"]["entities"]['"q"'] == kept  # q's rows were not written again
    with pytest.raises(Conflict):
        home.write(old, {"q"}, base)
    assert {r["id"] for r in home.open().entities.collect()} == {"b", "d"} and old.entities.count() == 2
    home.ingest("p", tables(spark, [("b", "asset", "B2", None, None)]))  # takes q's row over
    assert [(r["id"], r["name"], r["producer"]) for r in home.open().entities.collect()] == [("b", "B2", "p")]
    assert home.vacuum(1) > 0 and home.open().entities.count() == 1


def test_last_written_row_of_a_key_wins(spark):
    from lodestone.operators.store import upsert

    old = spark.createDataFrame([("a", "old"), ("b", "kept")], "id string, v string")
    new = spark.createDataFrame([("a", "first", 1), ("a", "last", 3), ("a", "middle", 2)], "id string, v string, seq int").repartition(3)
    assert {(r["id"], r["v"]) for r in upsert(old, new, ["id"]).collect()} == {("a", "last"), ("b", "kept")}


def test_search_answers_and_health(spark, tmp_path):
    home = Store(spark, "file://" + str(tmp_path / "store"))
    home.create()
    home.ingest("p", tables(spark, [("a", "asset", "Alpha", None, None), ("b", "asset", "Beta", None, None)], [("a", "b", "references")], [("c1", "a", "the running player jumps"), ("c2", "b", "nothing here")]))
    home.ingest("q", tables(spark, [("z", "asset", "Zed", None, None)], [], [("c3", "z", "a player runs")]))
    engine = Engine.open(home)
    assert {r["id"] for r in engine.search("runs").collect()} == {"a", "z"}  # both producers' postings, stemmed
    assert "[player]" in engine.search("player").first()["snippet"]
    checks = {r["check"]: (r["n"], r["ok"]) for r in engine.doctor().collect()}
    assert checks["healthy"] == (0, True) and checks["index-out-of-step"] == (0, True) and checks["schema-version"][1]
    home.ingest("q", tables(spark))
    assert {r["id"] for r in Engine.open(home).search("player").collect()} == {"a"}
    stale = Engine(home.open(), home.meta(), index=engine.index)
    assert {r["check"] for r in stale.doctor().where("not ok").collect()} == {"index-out-of-step", "healthy"}
    answer = engine.impact_answer("b")
    assert answer["summary"].first()["total_dependents"] == 1 and not answer["summary"].first()["truncated"]
