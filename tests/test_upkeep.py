"""Upkeep of a stored index: segments, several writers, old versions, changed files and assets, the change feed."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.api import Engine
from lodestone.functions import text
from lodestone.operators import search
from lodestone.operators.store import Snapshot, Store
from lodestone.plans import asset_build, build
from lodestone.schema import CHUNKS, EDGES, ENTITIES, validate
from lodestone.sources.files import Config
from lodestone.streaming import changes


def rows(spark, texts, producer=None, kind="asset"):
    """An entity and a chunk for each id."""
    e = spark.createDataFrame([(i, kind, i, "/Game/x", None, "asset", None, None, producer, None) for i in texts], ENTITIES)
    c = spark.createDataFrame([("c:" + i, i, "recipe-summary", t, None, producer) for i, t in texts.items()], CHUNKS)
    c = c.withColumn("aux", text.aux_tokens(F.col("entity_id"), F.col("text")))
    return Snapshot(e, spark.createDataFrame([], EDGES), validate(c, "chunks"))


def home_of(spark, tmp_path):
    home = Store(spark, "file://" + str(tmp_path / "store"))
    home.create()
    return home


def answers(engine, query):
    return [(r["id"], r["score"]) for r in engine.search(query).collect()]


def test_phrases_and_beginnings(spark):
    texts = {"a": "the BP_Player runs", "b": "player of the bp", "c": "bp, player; bp player", "d": "bp_players", "e": "plain"}
    state = rows(spark, texts)
    index = search.Index.build(state.chunks, stemmed=True)
    hits = lambda q, m: {r["chunk_id"][2:]: r["score"] for r in search.rank_chunks(index, q, m).collect()}
    assert set(hits("BP_Player", "and")) == {"a", "c", "d"}  # side by side, stemmed, in text or in the words split from it
    assert set(hits("player_bp", "and")) == {"c"} and set(hits("bp player", "and")) == {"a", "b", "c", "d"}
    plain = search.Index.build(state.chunks)
    hits = lambda q, m: {r["chunk_id"][2:] for r in search.rank_chunks(plain, q, m).collect()}
    assert hits("bp_play", "prefix") == {"a", "c", "d"} and hits("pl", "prefix") == {"a", "b", "c", "d", "e"} and hits("play", "prefix") == {"a", "b", "c", "d"}
    assert index.phrases("A_b a.B c") == [("a", "b"), ("a",), ("b",), ("c",)]


def test_prefix_keys_and_terms_are_pushed_to_the_scan(spark, tmp_path):
    state = rows(spark, {f"x{i}": f"word{i} other" for i in range(50)})
    search.Index.build(state.chunks).save(str(tmp_path / "index"))
    index = search.Index.load(spark, str(tmp_path / "index"))
    plan = lambda q, m: search.rank_chunks(index, q, m)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,wo)" in plan("wo", "prefix") and "postings" not in plan("wo", "prefix")
    assert "StringStartsWith(term,word1)" in plan("word1", "prefix") and "EqualTo(term,word1)" in plan("word1", "and")


def test_tiers_of_one_search(spark):
    state = rows(spark, {"a": "alpha beta", "b": "beta gamma", "c": "gammaray only"})
    index = search.Index.build(state.chunks)
    found = lambda q: [r["id"] for r in search.search(index, state.entities, state.edges, state.chunks, q).collect()]
    assert found("alpha beta") == ["a"] and set(found("alpha gamma")) == {"a", "b"} and found("gammar nothing") == ["c"] and found("?!") == []
    tiers = {r["chunk_id"]: r["tier"] for r in search.rank_tiers(index, "beta gamma").collect()}
    assert tiers == {"c:a": 1, "c:b": 0, "c:c": 2}


def test_one_changed_chunk_is_one_small_segment(spark, tmp_path):
    home = home_of(spark, tmp_path)
    texts = {f"e{i}": f"common word{i} harbour" for i in range(60)}
    home.ingest("p", rows(spark, texts))
    home.ingest("q", rows(spark, {"z": "common other"}))
    first = home.meta()["segments"]
    home.ingest("p", rows(spark, {**texts, "e7": "common lantern"}))
    second = home.meta()
    assert [s["name"] for s in second["segments"][: len(first) - 1]] == [s["name"] for s in first[:-1]]  # the large one stays
    assert second["segments"][-1]["chunks"] <= 2 and sum(s["chunks"] for s in second["segments"]) == 61
    for change in ({**texts, "e7": "common lantern", "e9": "a lantern"}, {k: v for k, v in texts.items() if k != "e3"}, {"n": "common"}):
        home.ingest("p", rows(spark, change))
        engine = Engine.open(home)
        again = Engine(home.open(), home.meta(), index=search.Index.build(home.open().chunks, stemmed=True))
        for query in ("common", "lantern", "word3", "harbour common", "lant"):
            assert answers(engine, query) == answers(again, query)
        assert engine.doctor().where("check = 'index-out-of-step'").first()["n"] == 0
    assert len(home.meta()["segments"]) <= 3
    meta = home.meta()
    fs, path = home._fs()
    fs.delete(path(f"{home.path}/{meta['segments'][0]['name']}"), True)
    assert home.heal() and not home.heal() and answers(Engine.open(home), "common")
    assert home.vacuum(1) > 0 and answers(Engine.open(home), "common")


def test_two_writers_both_succeed(spark, tmp_path):
    home, errors = home_of(spark, tmp_path), []

    def work(name):
        try:
            for i in range(2):
                Store(spark, home.path).ingest(name, rows(spark, {f"{name}{i}": f"text of {name}"}))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("p", "q")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and {r["id"] for r in home.open().entities.collect()} == {"p1", "q1"}
    assert {i for i, _ in answers(Engine.open(home), "text")} == {"p1", "q1"} and home.meta()["number"] == 5


def test_old_versions_are_read_and_upgraded(spark, tmp_path):
    home = Store(spark, "file://" + str(tmp_path / "store"))
    state = rows(spark, {"asset:/Game/BP_PlayerStart": "a start", "b": "running"}, "p")
    intent = rows(spark, {"doc:x": "told"}, "p", "document")
    for t, drop in (("entities", "authority"), ("edges", "none"), ("chunks", "aux")):
        getattr(state, t).unionByName(getattr(intent, t)).drop(drop).write.parquet(f"{home.path}/v-old/{t}/t0")
    fs, path = home._fs()
    stream = fs.create(path(f"{home.path}/current-000000000007"), True)
    stream.write(bytearray(json.dumps({"version": 2, "generation": "g", "tables": {t: {'"p"': f"v-old/{t}/t0"} for t in ("entities", "edges", "chunks")}}).encode()))
    stream.close()
    before = Engine.open(home)
    told = {r["id"]: r["authority"] for r in home.open().entities.collect()}
    assert told == {"asset:/Game/BP_PlayerStart": "extracted-fact", "b": "extracted-fact", "doc:x": "stated-intent"}
    seen = [answers(before, q) for q in ("player", "runs", "told")]
    assert all(seen) and home.meta()["number"] == 7  # reading has written nothing
    home.create()
    assert home.meta()["version"] == 6 and home.generation == "g" and not home.upgrade()
    assert [answers(Engine.open(home), q) for q in ("player", "runs", "told")] == seen
    home.ingest("q", rows(spark, {"n": "new"}))
    assert answers(Engine.open(home), "new") and [answers(Engine.open(home), "told")[0][0]] == ["doc:x"]
    meta = home.meta()
    home._name({**meta, "version": 99}, meta["number"] + 1)
    with pytest.raises(ValueError):
        home.open()


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)


def test_only_changed_files_are_read(spark, tmp_path):
    root, home = tmp_path / "project", Store(spark, "file://" + str(tmp_path / "store"))
    for i in range(6):
        write(root / "docs" / f"d{i}.md", f"# Title {i}\nfirst words of {i}\n")
    write(root / "Source" / "A.h", "UCLASS() class AShip : public AHull { UFUNCTION() void Sail(); };")
    write(root / "lodestone.json", '{"exclude": ["docs/d5.md"], "docTypes": {"docs/d0.md": "legal"}}')
    assert Config.read(spark, str(root)).exclude == ("docs/d5.md",) and Config.read(spark, str(tmp_path)) == Config()
    first = build.build(spark, str(root), home)
    assert first.ok and first.read[build.DOCS] == 5 and "doc:docs/d5.md" not in {r["id"] for r in home.open().entities.collect()}
    kept = os.stat(root / "docs" / "d1.md")
    write(root / "docs" / "d1.md", "# Title 1\nother words of 1\n")
    os.utime(root / "docs" / "d1.md", ns=(kept.st_atime_ns, kept.st_mtime_ns))  # the listing can't tell, so it isn't read
    write(root / "docs" / "d2.md", "# Title 2\nquite other words of two\n## More\nhere\n")
    (root / "docs" / "d3.md").unlink()
    second = build.build(spark, str(root), home)
    assert second.ok and second.read[build.DOCS] == 1
    state = home.open()
    texts = {r["entity_id"]: r["text"] for r in state.chunks.where("kind = 'doc-overview'").collect()}
    assert "first words" in texts["doc:docs/d1.md"] and "quite other" in texts["doc:docs/d2.md"] and "doc:docs/d3.md" not in texts and len(texts) == 4
    assert "doc:docs/d2.md#more" in {r["id"] for r in state.entities.collect()} and answers(Engine.open(home), "quite")
    assert build.check_sources(spark, str(root), home) is None  # no source has changed
    write(root / "Source" / "A.h", "UCLASS() class AShip : public AHull { UFUNCTION() void Sail(); UFUNCTION() void Moor(); };")
    write(root / "docs" / "d4.md", "# Title 4\nnot yet\n")
    assert build.check_sources(spark, str(root), home, Config.parse({"watch": False})) is None
    checked = build.check_sources(spark, str(root), home)
    assert checked.ok and set(checked.seconds) == {build.CODE} and build.check_sources(spark, str(root), home) is None
    ids = {r["id"] for r in home.open().entities.collect()}
    assert "cpp:Ship::Moor" in ids and not answers(Engine.open(home), "yet")
    checks = lambda: {r["check"]: r["ok"] for r in Engine.open(home).doctor(build.sources_fingerprint(spark, str(root), Config.read(spark, str(root)))).collect()}
    assert checks()["sources-changed"] is False and checks()["missing-tables"] and not checks()["healthy"]
    began = time.time()
    assert build.last_result(home, began) is None and build.last_result(home)["kind"] == build.CODE
    third = build.build(spark, str(root), home)
    assert build.last_result(home, began)["ok"] and checks()["sources-changed"] and checks()["healthy"]
    assert main(["doctor", home.path]) == 0 and main(["search", home.path, "--query", "yet"]) == 0 and main(["check", home.path, str(root)]) == 0
    assert third.read[build.DOCS] == 1 and answers(Engine.open(home), "yet")


def test_a_clock_checks_the_sources(spark, tmp_path):
    root, home = tmp_path / "project", Store(spark, "file://" + str(tmp_path / "store"))
    write(root / "Source" / "A.h", "UCLASS() class AShip : public AHull { UFUNCTION() void Sail(); };")
    assert build.check_sources(spark, str(root), home) is None  # no index yet
    build.build(spark, str(root), home)
    write(root / "Source" / "A.h", "UCLASS() class AShip : public AHull { UFUNCTION() void Anchor(); };")
    query = build.watch_sources(spark, str(root), home, str(tmp_path / "clock"), every="1 second")
    try:
        for _ in range(240):
            if "cpp:Ship::Anchor" in {r["id"] for r in home.open().entities.collect()}:
                break
            assert query.exception() is None
            threading.Event().wait(0.5)
        else:
            raise AssertionError("the source was not read again")
    finally:
        query.stop()


def registry_rows():
    light = {"intensity": 5.0, "red": 1, "green": 2, "blue": 3, "mobility": "Movable", "shadows": True, "visible": True}
    return [
        {"package": "/Game/Port", "name": "Port", "class": "World", "sig": "1", "actors": [
            {"actor": "Lamp1", "label": "Lamp_1", "class": "PointLight", "location": "0,0,0", "light": light},
            {"actor": "Boat1", "label": "Boat_1", "class": "BP_Boat_C", "class_package": "/Game/BP_Boat", "props": '{"Speed": 4, "Hull": {"Coat": "/Game/M_Red.M_Red"}}', "defaults": '{"Speed": 4}'}]},
        {"package": "/Game/S_Hull", "name": "S_Hull", "class": "StaticMesh", "sig": "1", "mesh": {"lods": 2, "triangles": 90, "materials": ["/Game/M_Red"]}, "deps": ["/Game/M_Red", "/Engine/X"]},
        {"package": "/Game/M_Red", "name": "M_Red", "class": "Material", "sig": "1", "material": {"blend": "Opaque", "two_sided": False, "textures": [{"param": "Base", "texture": "/Game/T_Red"}]}},
        {"package": "/Game/T_Red", "name": "T_Red", "class": "Texture2D", "sig": "1", "tags": {"Dimensions": "64x32"}},
        {"package": "/Game/BP_Boat", "name": "BP_Boat", "class": "Blueprint", "sig": "1", "tags": {"NativeParentClass": "Class'/Script/Port.Ship'"}, "members": [{"member": "function", "name": "Sail"}, {"member": "variable", "name": "Knots", "type": "int", "value": "12"}, {"member": "interface", "ref": "cpp:Floating"}]},
        {"package": "/Game/Bank", "name": "Bank", "class": "SoundBank", "sig": "1", "props": '{"Voices": 8, "Mix": {"Gain": 0.5}}', "defaults": '{"Voices": 2}'},
        {"package": "/Game/Far/S_Rock", "name": "S_Rock", "class": "StaticMesh", "sig": "1", "mesh": {"lods": 1, "triangles": 5, "materials": []}, "tags": {"Size": "small"}},
        {"package": "/Engine/Y", "name": "Y", "class": "StaticMesh", "sig": "1"},
    ]


def test_assets_levels_and_scripts_in_the_build(spark, tmp_path):
    root, home = tmp_path / "project", Store(spark, "file://" + str(tmp_path / "store"))
    write(root / "docs" / "port.md", "# Port\nSee asset:/Game/Port and S_Hull.\n")
    table = tmp_path / "registry.json"
    put = lambda found: write(table / "rows.json", "\n".join(map(json.dumps, found)))
    found = registry_rows()
    put(found)
    config = Config(registry=str(table), shallow=("/Game/Far",))
    first = build.build(spark, str(root), home, config)
    assert first.ok, home.meta()["lastResult"]
    state = home.open()
    kinds = {r["id"]: (r["kind"], r["producer"]) for r in state.entities.collect()}
    assert kinds["asset:/Game/Port"] == ("asset", "registry@1") and kinds["asset:/Game/BP_Boat"] == ("blueprint", "registry@1") and "asset:/Engine/Y" not in kinds
    assert kinds["asset:/Game/Port::actor::Lamp1"] == ("level-actor", "assets@1") and kinds["asset:/Game/BP_Boat::Sail"] == ("bp-function", "scripts@1")
    assert {r["id"]: r["detail"] for r in state.entities.collect()}["asset:/Game/BP_Boat::var::Knots"] == '{"type":"int","default":"12"}'
    edges = {(r["src"], r["dst"], r["type"], r["attrs"]) for r in state.edges.collect()}
    boat = "asset:/Game/Port::actor::Boat1"
    assert {
        ("asset:/Game/Port", "asset:/Game/BP_Boat", "references", '{"via":"places"}'), ("asset:/Game/Port", "cpp:PointLight", "references", '{"via":"places"}'),
        (boat, "asset:/Game/Port", "placed-in-level", None), (boat, "asset:/Game/BP_Boat", "instance-of", None), (boat, "asset:/Game/M_Red", "references", '{"via":"Coat"}'),
        ("asset:/Game/S_Hull", "asset:/Game/M_Red", "depends-on", None), ("asset:/Game/S_Hull", "asset:/Game/M_Red", "uses-material", None),
        ("asset:/Game/M_Red", "asset:/Game/T_Red", "uses-texture", None), ("asset:/Game/BP_Boat", "cpp:Ship", "inherits", None), ("asset:/Game/BP_Boat", "cpp:Floating", "implements", None),
        ("doc:docs/port.md#port", "asset:/Game/Port", "describes", '{"confidence":"explicit","via":"id"}'),
    } <= edges
    texts = {r["entity_id"]: r["text"] for r in state.chunks.collect()}
    assert "Actors: 2 in 2 classes" in texts["asset:/Game/Port"] and "Triangles(LOD0): 90" in texts["asset:/Game/S_Hull"] and "64x32" in texts["asset:/Game/T_Red"]
    assert texts["asset:/Game/Bank"] == "Mix.Gain=0.5, Voices=8" and texts[boat].endswith("Hull.Coat=M_Red") and "intensity=5" in texts["asset:/Game/Port::actor::Lamp1"]
    assert texts["asset:/Game/Far/S_Rock"] == "S_Rock (StaticMesh)\nSize=small"  # told shortly
    found[1] |= {"sig": "2", "mesh": {"lods": 2, "triangles": 91, "materials": ["/Game/M_Red"]}}
    found[2]["material"]["blend"] = "Masked"  # its signature says that nothing has changed
    del found[5]
    put(found)
    second = build.build(spark, str(root), home, config)
    assert second.ok and second.read[asset_build.ASSETS] == 1
    texts = {r["entity_id"]: r["text"] for r in home.open().chunks.collect()}
    assert "Triangles(LOD0): 91" in texts["asset:/Game/S_Hull"] and "Blend: Opaque" in texts["asset:/Game/M_Red"] and "asset:/Game/Bank" not in texts
    ids = {r["id"] for r in home.open().entities.collect()}
    assert "asset:/Game/Bank" not in ids and {"asset:/Game/S_Hull", boat, "asset:/Game/BP_Boat::Sail"} <= ids


def test_the_feed_survives_restarts_and_late_batches(spark, tmp_path):
    home, calls = home_of(spark, tmp_path), []
    feed = tmp_path / "feed"
    feed.mkdir()

    def extract(packages):
        calls.append(sorted(r[0] for r in packages.collect()))
        id = F.concat(F.lit("asset:"), F.col("package"))
        e = packages.select(id.alias("id"), F.lit("asset").alias("kind"), F.col("package").alias("name"), F.col("package").alias("path"), F.lit("asset").alias("source"))
        return Snapshot(validate(e, "entities"), spark.createDataFrame([], EDGES), spark.createDataFrame([], CHUNKS))

    def run(number, *events):
        (feed / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "op", "package", "old_package"), e))) for e in events))
        query = changes.follow(changes.read_changes(spark, str(feed)), home, extract, "assets", str(tmp_path / "check"))
        query.awaitTermination(240)
        assert query.exception() is None
        return {r["id"].removeprefix("asset:/Game/") for r in home.open().entities.collect()}

    assert run(0, (5, "save", "/Game/A"), (6, "save", "/Game/B"), (1, "delete", "/Game/A")) == {"A", "B"}
    assert run(1, (7, "delete", "/Game/B"), (8, "rename", "/Game/C", "/Game/A")) == {"C"}
    number = home.meta()["number"]
    assert run(2, (6, "save", "/Game/B"), (2, "save", "/Game/A"), (8, "save", "/Game/C")) == {"C"}  # late and repeated
    assert home.meta()["number"] == number and calls == [["/Game/A", "/Game/B"], ["/Game/C"]]
    (tmp_path / "check" / "commits" / "1").unlink()  # the stream stopped after the batch's version, before its commit
    for extra in (".1.crc",):
        (tmp_path / "check" / "commits" / extra).unlink(missing_ok=True)
    (tmp_path / "check" / "commits" / "2").unlink()
    (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert run(3, (9, "save", "/Game/E")) == {"C", "E"}
    assert usual_provider(spark)


def usual_provider(spark):
    return "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")
