"""Documents, files and the change feed."""

import struct

from pyspark.sql import functions as F

from lodestone.operators import assets, markup, store
from lodestone.operators.store import Snapshot, Store
from lodestone.plans.maintenance import sample_docx, sample_pdf
from lodestone.schema import CHUNKS, EDGES, ENTITIES
from lodestone.sources import extracts, files
from lodestone.streaming import changes


def test_html_document(spark):
    page = "<html><head><title>My &amp; page</title><style>p{}</style></head><body><script>x()</script><h2>One</h2><p>first</p><h3>Two</h3><ul><li>item</ul></body></html>"
    entities, chunks = markup.document_rows(spark.createDataFrame([("docs/a.html", page), ("Plugins/x.md", "# no"), ("b.bin", "x")], "rel string, text string"))
    rows = {r["id"]: r["name"] for r in entities.collect()}
    assert rows == {"doc:docs/a.html": "a.html", "doc:docs/a.html#one": "One", "doc:docs/a.html#two": "Two"}
    assert not [r for r in chunks.collect() if "x()" in r["text"] or "p{}" in r["text"]]


def test_markdown_slugs(spark):
    text = "intro\n# A\nx\n# A\n## A-2 ##\n"
    got = [(r["section"], r["slug"], r["level"]) for r in markup.section_slugs(markup.markdown_sections(spark.createDataFrame([(1, text)], "doc int, text string"))).orderBy("section").collect()]
    assert got[0] == (0, "overview", 0) and len({s for _, s, _ in got}) == 4 and [level for *_, level in got] == [0, 1, 1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "docs" / "Saved").mkdir(parents=True)
    (tmp_path / "docs" / "a.MD").write_bytes("﻿# Ä".encode("utf-8"))
    (tmp_path / "docs" / "u.md").write_bytes("# B".encode("utf-16"))
    (tmp_path / "docs" / "Saved" / "b.md").write_text("# no")
    (tmp_path / "docs" / "d.docx").write_bytes(sample_docx("Word"))
    (tmp_path / "docs" / "p.pdf").write_bytes(sample_pdf("Hello"))
    (tmp_path / "docs" / "bad.pdf").write_bytes(b"%PDF nothing")
    got = {r["rel"]: r["text"] for r in files.with_text(files.walk_files(spark, str(tmp_path), ("md", "docx", "pdf"))).collect()}
    assert got == {"docs/a.MD": "# Ä", "docs/u.md": "# B", "docs/d.docx": "## Word\na & b", "docs/p.pdf": "Hello\nsecond", "docs/bad.pdf": ""}
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 40, 30)
    sizes = files.with_image_size(spark.createDataFrame([("i.png", bytearray(png)), ("x", bytearray(b"?"))], "rel string, content binary")).collect()
    assert [tuple(r)[1:] for r in sizes] == [("png", 40, 30), ("", 0, 0)]
    config = files.Config.parse({"exclude": ["a"], "shallowPaths": ["/Game/X/", "no"], "docTypes": {"d": "legal"}, "externalDocs": [{"source": "s", "path": "p"}, {}]})
    assert config.shallow == ("/Game/X",) and config.external == (("s", "p"),)


def test_extract_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("asset:/Game/A", "asset", "A", "/Game/A", "", "asset", None, '{"class":"X"}', None, None)], ENTITIES)
    state = Snapshot(e, spark.createDataFrame([], EDGES), spark.createDataFrame([("c", "asset:/Game/A", "k", "t", None, None)], CHUNKS))
    extracts.write_extract(state, str(tmp_path / "x"), "p", "proj", "/r", "2026-01-01T00:00:00Z", ["asset:/Game/A"])
    (tmp_path / "x" / "bad.json").write_text("{ nope")
    (tmp_path / "x" / "a-hashes.json").write_text('{"producer": "q"}')
    docs = extracts.read_extracts(spark, str(tmp_path / "x"))
    row = docs.first()
    assert docs.count() == 1 and row["mode"] == "delta" and row["replaces"] == ["asset:/Game/A"]
    back = extracts.snapshot_of(docs)
    assert back.entities.first()["parent"] is None and back.entities.first()["producer"] == "p" and back.chunks.count() == 1


def test_change_feed(spark, tmp_path):
    home = Store(spark, "file://" + str(tmp_path / "store"))

    def extract(packages):
        id = F.concat(F.lit("asset:"), F.col("package"))
        rows = packages.select(id.alias("id"), F.lit("asset").alias("kind"), F.col("package").alias("name"), F.col("package").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("asset").alias("source"))
        from lodestone.schema import validate

        return Snapshot(validate(rows, "entities"), spark.createDataFrame([], EDGES), spark.createDataFrame([], CHUNKS))

    home.create()
    feed = tmp_path / "feed"
    feed.mkdir()
    lines = ['{"seq":1,"op":"save","package":"/Game/A"}\n{"seq":2,"op":"save","package":"/Game/B"}\n{"seq":3,"op":"save","package":"/Engine/C"}\n', '{"seq":4,"op":"rename","package":"/Game/D","old_package":"/Game/A"}\n{"seq":5,"op":"delete","package":"/Game/B"}\n']
    for i, text in enumerate(lines):
        (feed / f"{i}.json").write_text(text)
        changes.follow(changes.read_changes(spark, str(feed)), home, extract, "assets", str(tmp_path / "check")).awaitTermination(120)
    assert {r["id"] for r in home.open().entities.collect()} == {"asset:/Game/D"}
    late = spark.createDataFrame([(2, None, "save", "/Game/B", None)], changes.SCHEMA)
    done = spark.createDataFrame([("/Game/B", 5)], "package string, seq long")
    assert changes.apply_changes(home.open(), late, extract, "assets", done)[0].entities.count() == 1


def test_pseudocode():
    nodes = [("e", "Event", True, 0), ("b", "Branch", False, 1), ("x", "Print", False, 2), ("p", "Get", False, 3)]
    pins = [("e", "then", "out", True, "b", "", 0), ("b", "exec", "in", True, "e", "", 0), ("b", "cond", "in", False, "p", "", 1), ("b", "true", "out", True, "x", "", 2), ("b", "false", "out", True, "x", "", 3), ("x", "exec", "in", True, "b", "", 0), ("x", "text", "in", False, None, "hi", 1), ("p", "value", "out", False, "b", "", 0)]
    assert assets.render(nodes, pins).split("\n") == ["Event", "  Branch(cond=Get)", "    [true]", "    Print(text=hi)", "    [false]", "    Print (see above)"]
    assert assets.render([("a", "A", False, 1), ("b", "B", False, 0)], []) == "B\nA"


def test_signatures_and_history(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", "4")], "id string, sig string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", ""), ("e", "5")], "id string, sig string")
    assert {r["id"]: r["change"] for r in store.diff_signatures(old, new).collect()} == {"a": "same", "b": "changed", "c": "changed", "d": "removed", "e": "added"}
    runs = spark.createDataFrame([(i, "x") for i in range(30)], "at int, what string")
    assert {r["at"] for r in store.keep_newest(runs, "at").collect()} == set(range(10, 30))


def test_each_font_of_a_pdf_has_its_own_glyphs():
    def table(pairs):
        return "begincmap begincodespacerange <00> <FF> endcodespacerange " + "beginbfchar " + " ".join(f"<{a:02x}> <{ord(b):04x}>" for a, b in pairs) + " endbfchar endcmap"

    def stream(n, text):
        return f"{n} 0 obj <</Length {len(text)}>> stream\n{text}\nendstream endobj\n"

    parts = [
        "1 0 obj <</Type /Page /Resources 2 0 R /Contents 3 0 R>> endobj\n",
        "2 0 obj <</Font <</F1 4 0 R /F2 5 0 R>> >> endobj\n",
        stream(3, "BT /F1 12 Tf <0102> Tj /F2 9 Tf <0102> Tj /F1 9 Tf (\\001) Tj ET"),
        "4 0 obj <</Type /Font /ToUnicode 6 0 R>> endobj\n",
        "5 0 obj <</Type /Font /ToUnicode 7 0 R>> endobj\n",
        stream(6, table([(1, "A"), (2, "B")])),
        stream(7, table([(1, "x"), (2, "y")])),
    ]
    assert files.pdf_text(("%PDF-1.4\n" + "".join(parts)).encode("latin-1")) == "ABxyA"
