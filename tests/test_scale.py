"""Single searches, walks and links do no more than their answer needs."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import assets, graph, intent, lineage, search
from lodestone.plans import core, registry
from lodestone.sources.projection import Project

DATA = "/root/testdata/sf0.001"


def _chunks(spark):
    rows = [("c1", "e1", "The order of rings", "Big Gun"), ("c2", "e2", "order order rings_order", None), ("c3", "e3", "ordered ringing of the", "order"), ("c4", "e4", "", ""), ("c5", "e5", None, "rings"), ("c6", "e6", "Of the sea", None)]
    return spark.createDataFrame([(i, e, "doc-section", t, a) for i, e, t, a in rows], "id string, entity_id string, kind string, text string, aux string")


@pytest.mark.parametrize("query, mode", [("order", "and"), ("order rings", "or"), ("rings_order the", "or"), ("of_th ri", "prefix"), ("nothing", "or"), ("", "and")])
@pytest.mark.parametrize("stemmed", [False, True])
def test_texts_answer_as_their_index(spark, query, mode, stemmed):
    chunks = _chunks(spark).where("text is not null")
    told = lambda df: sorted((r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert told(search.rank_chunks(search.Texts(chunks, stemmed), query, mode)) == told(search.rank_chunks(search.Index.build(chunks, stemmed), query, mode))


def test_a_null_text_counts_without_a_length(spark):
    chunks = _chunks(spark)
    told = lambda df: sorted((r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert told(search.rank_chunks(search.Texts(chunks), "order")) == told(search.rank_chunks(search.Index.build(chunks), "order"))


def test_terms_are_found_once_a_pass(spark):
    ranked = search.rank_chunks(search.Texts(_chunks(spark)), "rings_order of", "or")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("regexp_extract_all" in line for line in filters)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_registered_search_makes_no_index(spark, monkeypatch):
    def never(*_):
        raise AssertionError("an index was made")

    monkeypatch.setattr(search.Index, "build", never)
    assert registry.queries()["bm25_or"](spark, DATA).count() == 20


def test_a_walk_ends_where_the_page_is_full(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i}", "root", "references") for i in range(4)] + [("far", "n0", "references"), ("farther", "far", "references")], "src string, dst string, type string")
    entities = spark.createDataFrame([(i, "asset", i) for i in ("root", "n0", "n1", "n2", "far", "farther")], "id string, kind string, name string")
    looked = []
    of = graph._Links.of
    monkeypatch.setattr(graph._Links, "of", lambda self, end, frontier: looked.append(end) or of(self, end, frontier))
    ids = lambda df: [r["id"] for r in df.orderBy("depth", "id").collect()]
    assert ids(graph.references(entities, edges, "root", "in", 3, limit=3)) == ["n0", "n1", "n2"] and len(looked) == 1
    looked.clear()  # n3 is no entity, so four need another hop
    assert ids(graph.references(entities, edges, "root", "in", 3, limit=4)) == ["n0", "n1", "n2", "far"] and len(looked) == 2
    monkeypatch.setattr(graph, "IMPACT_CAP", 3)
    looked.clear()
    assert graph.impact_summary(entities, edges, "root").first()["total_dependents"] == 3 and len(looked) == 1


def test_common_words_that_name_nothing_are_not_joined(spark):
    entities = spark.createDataFrame([("a", "asset", "BigGun_A"), ("b1", "asset", "Many_X"), ("b2", "asset", "Many_X"), ("b3", "asset", "Many_X"), ("b4", "asset", "Many_X"), ("d1", "document", "One"), ("d2", "document", "Two")], "id string, kind string, name string")
    chunks = spark.createDataFrame([("d1", "o_totalprice BigGun_A Many_X small"), ("d2", "o_totalprice"), ("a", "BigGun_A")], "entity_id string, text string")
    links = intent.inferred_links(entities, chunks)
    assert [(r["src"], r["dst"]) for r in links.collect()] == [("d1", "a")]
    assert "regexp_extract_all" not in links._jdf.queryExecution().optimizedPlan().toString()  # words are found before, once


def test_drift_without_limit_is_not_gathered(spark):
    part = spark.range(3).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"))
    entities = part.select("id", F.lit('{"size":1}').alias("detail"))
    chunks = part.select("id", F.concat(F.lit("d"), "id").alias("entity_id"), F.lit("doc-section").alias("kind"), F.lit("size = 2").alias("text"))
    edges = part.select(F.concat(F.lit("d"), "id").alias("src"), F.col("id").alias("dst"), F.lit("describes").alias("type"))
    found = intent.drift(entities, edges, chunks, None)
    assert found.count() == 3 and "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_json_of_a_small_file_is_dealt_out(spark):
    objects = spark.range(8).coalesce(1).select(F.col("id").cast("string").alias("owner"), F.lit('{"Size":1}').alias("props"), F.lit('{"Size":2}').alias("defaults"))
    plan = assets.flatten_properties(objects)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 2


@pytest.mark.parametrize("query, mode", [("a_a", "or"), ("ab_a", "prefix"), ("a_b_a b", "and"), ("é", "prefix")])
def test_texts_count_phrases_that_overlap_themselves(spark, query, mode):
    chunks = spark.createDataFrame([("c1", "a a a b a b a", None), ("c2", "ab ab ab a,b--a b É é-éa", "a A"), ("c3", "..a", "b a"), ("c4", "", None)], "id string, text string, aux string")
    told = lambda df: sorted((r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert told(search.rank_chunks(search.Texts(chunks), query, mode)) == told(search.rank_chunks(search.Index.build(chunks), query, mode))


def test_words_of_a_stem_begin_as_it_does():
    heads = ("relat", "hop", "hopp", "fil", "sensib", "happ", "activ", "pon", "control", "controll", "vietnam", "order", "ring", "valen", "form", "a", "tr", "conflat", "probat")
    ends = ("", "s", "es", "ed", "ing", "ings", "e", "y", "ies", "ational", "ation", "ator", "ility", "ilities", "ibility", "ability", "ization", "izer", "iveness", "ivity", "fulness", "ency", "ancy", "ably", "ally", "ently", "ously", "alism", "icate", "ative", "alize", "ical", "eed", "eedly", "ional", "ment", "ement")
    for word in (h + e for h in heads for e in ends):
        assert word.startswith(search._begins(search.stem(word))), word


def test_a_table_in_few_row_groups_is_dealt_out(spark, tmp_path):
    whole = Project(spark, str(tmp_path))
    texts = spark.range(lineage.MOST_ROWS + 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    texts.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    texts.limit(10).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    tasks = lambda name: whole.spread(name).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks("documents") > 1 and tasks("pages") == 1
    plan = core._documents(whole).counts([("a",)], (False,), 0.6, {}, having=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan.split("RepartitionByExpression")[0]  # what costs much comes after the dealing
    assert "regexp_replace" not in plan.split("RepartitionByExpression")[1] and "contains" not in plan.split("RepartitionByExpression")[1]


def test_aux_tokens_split_parted_words_alone(spark):
    texts = ["BP_BigGun ABC ABCd aB _x_ __ x1Y 1Éa éÉ plain", "nothing Here TO see", "aB aB b_", "ŒuvreŒ·xY", "", "a" * 199 + "Bc"]
    rows = spark.createDataFrame([(f"asset:/Game/MyMap/{i}::A_b:c", t) for i, t in enumerate(texts)], "id string, text string")
    source = F.concat_ws(" ", F.translate("id", "/:", "  "), F.left("text", F.lit(200)))
    split = F.transform(text.word_tokens(source), lambda w: F.trim(text.split_camel(F.translate(w, "_", " "))))
    kept = F.filter(F.arrays_zip(text.word_tokens(source).alias("w"), split.alias("s")), lambda p: (p["w"] != p["s"]) & (p["s"] != ""))
    expected = F.array_join(F.slice(F.array_distinct(F.transform(kept, lambda p: p["s"])), 1, 24), " ")
    for r in rows.select(text.aux_tokens(F.col("id"), F.col("text")).alias("got"), expected.alias("wanted")).collect():
        assert r["got"] == r["wanted"]
    assert rows.select(text.aux_tokens(F.lit("plain/x"), F.lit("No Part")).alias("a")).first()["a"] == ""


@pytest.mark.parametrize("stemmed", [False, True])
def test_a_single_search_finds_terms_once(spark, monkeypatch, stemmed):
    made = []
    of = search.spaced_terms
    monkeypatch.setattr(search, "spaced_terms", lambda c: made.append(c) or of(c))
    chunks = _chunks(spark)
    assert search.rank_chunks(search.Texts(chunks, stemmed), "order rings", "or").count() == 4
    assert len(made) == 2  # of text and aux, in one pass
    assert search.rank_chunks(search.Texts(chunks.limit(0), stemmed), "order", "or").count() == 0


@pytest.mark.parametrize("most", [1, 3, 8])
@pytest.mark.parametrize("digits", [None, 1])
@pytest.mark.parametrize("filters", [{}, {"kind": "asset", "path_prefix": "/Game/1"}])
def test_a_page_is_that_of_all_hits(spark, monkeypatch, most, digits, filters):
    kinds, details = ("level-actor", "asset", "blueprint"), ('{"assetClass":"Texture2D"}', None)
    entities = spark.createDataFrame([(f"asset:/Game/{i}", kinds[i % 3], f"n{i}", f"/Game/{i}", details[i % 5 > 0]) for i in range(40)], "id string, kind string, name string, path string, detail string")
    rows = [(f"c{i}", f"asset:/Game/{i * 7 % 44}", ("cpp-body", "doc-section")[i % 4 > 0], -round(0.31 * (i * 13 % 11), 2) - 0.01) for i in range(90)]
    ranked = spark.createDataFrame(rows, "chunk_id string, entity_id string, chunk_kind string, score double")
    shown = F.col("score") if digits is None else F.round("score", digits)
    whole = search.best_chunks(search._owned(ranked, entities, ranked, **filters)).orderBy(shown, "id").limit(most)
    told = lambda df: sorted((r["id"], r["chunk_id"], r["score"]) for r in df.collect())
    monkeypatch.setattr(search, "_LIKELY_PAGES", 1)
    for likely in (1, 20, 2000):
        monkeypatch.setattr(search, "LIKELY", likely)
        assert told(search.best_page(ranked, entities, ranked, most, digits=digits, **filters)) == told(whole)


def test_entities_that_lower_a_score_are_joined_only_where_it_still_counts(spark, monkeypatch):
    rows = [(f"a{i:03}", "level-actor", None) for i in range(30)] + [("b1", "asset", '{"assetClass":"Texture2D"}')] + [(f"c{i}", "asset", None) for i in range(3)]
    entities = spark.createDataFrame([(i, kind, i, "", detail) for i, kind, detail in rows], "id string, kind string, name string, path string, detail string")
    ranked = spark.createDataFrame([("k" + i, i, "doc-section", -1.0) for i, _, _ in rows], "chunk_id string, entity_id string, chunk_kind string, score double")
    monkeypatch.setattr(search, "LIKELY", 5)
    monkeypatch.setattr(search, "_LIKELY_PAGES", 1)
    joined, of = [], search._owned
    monkeypatch.setattr(search, "_owned", lambda hits, owners, *a, **k: joined.append(sorted(r["id"] for r in owners.select("id").collect())) or of(hits, owners, *a, **k))
    assert [r["id"] for r in search.best_page(ranked, entities, ranked, 3).collect()] == ["c0", "c1", "c2"]
    assert joined == [["a000", "a001", "a002", "a003", "a004"], ["c0", "c1", "c2"]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_patch_deals_out_no_texts(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a table was dealt out")

    monkeypatch.setattr(Project, "spread", never)
    assert registry.queries()["producer_delta"](spark, DATA).count() == 5
