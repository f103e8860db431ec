"""Queries over the index: statistics, graph, search, intent; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_title, html_to_text, index_terms, split_camel, word_tokens
from ..operators import graph, intent, search, stats
from ..schema import SEVERITY, project_entity
from ..sources.projection import CHUNKS, EDGES, ENTITIES, Project, statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    """Registers a query over a Project; `needs` names the parts of the index that its SQL uses."""

    def register(f: Callable[[Project], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Project(spark, sf_dir))
        if sql is not None:
            parts = {"entities": ENTITIES, "edges": EDGES, "chunks": CHUNKS}
            heads = [f"{n} AS ({statement(parts[n])})" for n in needs]
            body = sql.strip()
            recursive = body.startswith("RECURSIVE ")
            body = body.removeprefix("RECURSIVE ")
            if heads:
                body = ", ".join(heads) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
                body = "WITH " + "RECURSIVE " * recursive + body
            SQL[name] = body
        return f

    return register


CLASS = "coalesce(json_extract_string(detail, '$.class'), kind)"

query("stats_kinds", "SELECT kind, count(*) AS n FROM entities GROUP BY kind", "entities")(lambda p: stats.kinds(p.entities))
query("stats_edge_types", "SELECT type, count(*) AS n FROM edges GROUP BY type", "edges")(lambda p: stats.edge_types(p.edges))
# What stands in a level isn't a use of it.
query("stats_unused", "SELECT id, kind, name FROM entities WHERE kind IN ('asset', 'blueprint') AND NOT EXISTS (SELECT 1 FROM edges WHERE dst = id AND type <> 'placed-in-level') ORDER BY id LIMIT 500", "entities", "edges")(lambda p: stats.unused(p.entities, p.edges.where("type <> 'placed-in-level'")))
query("stats_largest_deps", "SELECT id, kind, name, n FROM (SELECT src, count(*) AS n FROM edges GROUP BY src) d JOIN entities ON id = src ORDER BY n DESC, id LIMIT 50", "entities", "edges")(lambda p: stats.largest_dependencies(p.entities, p.edges))
query("stats_authority", "SELECT coalesce(authority, 'extracted-fact') AS authority, count(*) AS n FROM entities GROUP BY 1", "entities")(lambda p: stats.authority(p.entities))
query("stats_doc_types", "SELECT coalesce(json_extract_string(detail, '$.docType'), 'other') AS doc_type, count(*) AS n FROM entities WHERE kind = 'document' GROUP BY 1", "entities")(lambda p: stats.doc_types(p.entities))
query("stats_overview", "SELECT 'total' AS part, 'entities' AS key, count(*) AS n FROM entities UNION ALL SELECT 'kind', kind, count(*) FROM entities GROUP BY kind UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type", "entities", "edges")(lambda p: stats.overview(p.entities, p.edges))
query("health_producers", "SELECT coalesce(producer, '(none)') AS producer, count(*) AS n FROM entities GROUP BY 1", "entities")(lambda p: stats.by_producer(p.entities))
LEVELS = "SELECT entity_id, CAST(regexp_extract(text, 'Actors: ([0-9]+)', 1) AS BIGINT) AS stated, (SELECT count(*) FROM entities WHERE parent = entity_id) AS indexed FROM chunks WHERE kind = 'recipe-summary' AND regexp_matches(text, '(?s)\\(Level\\).*Actors: [0-9]')"
query("level_coverage", f"SELECT *, stated > 0 AND indexed = 0 AS problem FROM ({LEVELS}) x", "entities", "chunks")(lambda p: stats.level_coverage(p.entities, p.chunks))
query(
    "health_report",
    f"""SELECT 'entities' AS "check", count(*) AS n, count(*) > 0 AS ok FROM entities UNION ALL SELECT 'edges', count(*), true FROM edges UNION ALL SELECT 'chunks', count(*), true FROM chunks
    UNION ALL SELECT 'chunks-without-entity', count(*), count(*) = 0 FROM chunks WHERE entity_id NOT IN (SELECT id FROM entities)
    UNION ALL SELECT 'repeated-entities', count(*), count(*) = 0 FROM (SELECT id FROM entities GROUP BY id HAVING count(*) > 1) r
    UNION ALL SELECT 'levels-without-actors', count(*), count(*) = 0 FROM ({LEVELS}) x WHERE stated > 0 AND indexed = 0""",
    "entities", "edges", "chunks",
)(lambda p: stats.doctor(p.entities, p.edges, p.chunks))

PART, NATION, CUSTOMER, REGION = "asset:/Game/part/5", "asset:/Game/nation/3", "asset:/Game/customer/7", "asset:/Game/region/1"
query("entity_point_lookup", f"SELECT id, kind, name, path, nullif(parent, '') AS parent, source, nullif(summary, '') AS summary, detail, coalesce(authority, 'extracted-fact') AS authority FROM entities WHERE id = '{PART}'", "entities")(lambda p: p.entities.where(F.col("id") == PART).select(*project_entity()))
query("entity_counts", f"SELECT '{CUSTOMER}' AS id, (SELECT count(*) FROM edges WHERE src = '{CUSTOMER}') AS n_out, (SELECT count(*) FROM edges WHERE dst = '{CUSTOMER}') AS n_in, (SELECT count(*) FROM entities WHERE parent = '{CUSTOMER}') AS n_children, (SELECT count(*) FROM chunks WHERE entity_id = '{CUSTOMER}') AS n_chunks", "entities", "edges", "chunks")(lambda p: graph.entity_counts(p.entities, p.edges, p.chunks, CUSTOMER))
CHILDREN = f"SELECT *, row_number() OVER (PARTITION BY class ORDER BY id) AS turn, count(*) OVER (PARTITION BY class) AS class_size, count(*) OVER () AS total FROM (SELECT id, kind, name, {CLASS} AS class FROM entities WHERE parent = '%s') c"
query("children_page", f"SELECT * FROM ({CHILDREN % CUSTOMER} WHERE contains(lower(class), 'i')) x ORDER BY turn, class_size, class, id LIMIT 5 OFFSET 2", "entities")(lambda p: graph.children(p.entities, CUSTOMER, "I", 5, 2))
query("children_round_robin", f"SELECT * FROM ({CHILDREN % NATION}) x ORDER BY turn, class_size, class, id LIMIT 50", "entities")(lambda p: graph.children(p.entities, NATION))
query("children_by_class", f"SELECT {CLASS} AS class, count(*) AS n FROM entities WHERE parent = '{NATION}' GROUP BY 1", "entities")(lambda p: graph.children_by_class(p.entities, NATION))


@query("level_selection", "WITH a AS (SELECT n_name AS level, 'c' || CAST(c_custkey AS STRING) AS actor, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'HLODActor' ELSE c_mktsegment END AS class FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY level, class ORDER BY actor) AS turn, count(*) OVER (PARTITION BY level, class) AS class_size FROM a WHERE class NOT IN ('WorldPartitionHLOD', 'WorldPartitionMiniMap', 'HLODActor')), o AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY turn, class_size, class, actor) AS place FROM r) SELECT level, actor, class, place FROM o WHERE place <= 20")
def _level_selection(p: Project) -> DataFrame:
    named = p.table("customer").join(p.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "HLODActor").otherwise(F.col("c_mktsegment"))
    return stats.select_actors(named.select(F.col("n_name").alias("level"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("actor"), kind.alias("class")), 20)


query("class_histogram", "SELECT n_name AS level, c_mktsegment AS class, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")(lambda p: stats.class_histogram(p.table("customer").join(p.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("level"), F.col("c_mktsegment").alias("class"))))


def _walk_sql(root: str, inbound: bool, depth: int, edge_type: str = "") -> str:
    """Shallowest hops as id, depth, via."""
    near, far = ("dst", "src") if inbound else ("src", "dst")
    own = f" AND e.type = '{edge_type}'" if edge_type else ""
    name = "w_in" if inbound else "w_out"
    return f"{name} AS (SELECT '{root}' AS id, CAST('' AS VARCHAR) AS via, 0 AS depth UNION SELECT e.{far}, e.type, w.depth + 1 FROM {name} w JOIN edges e ON e.{near} = w.id{own} WHERE w.depth < {depth}), {name}_best AS (SELECT id, min(depth) AS depth FROM {name} WHERE id <> '{root}' GROUP BY id), {name}_rows AS (SELECT b.id, b.depth, min(w.via) AS via FROM {name}_best b JOIN {name} w ON w.id = b.id AND w.depth = b.depth GROUP BY ALL)"


SHOWN = "SELECT r.id, kind, name, '{0}' AS direction, depth, via FROM {1}_rows r JOIN entities e ON e.id = r.id"
query("refs_in_depth1", f"RECURSIVE WITH {_walk_sql(NATION, True, 1)} {SHOWN.format('in', 'w_in')} ORDER BY depth, r.id LIMIT 200", "entities", "edges")(lambda p: graph.references(p.entities, p.edges, NATION, "in", 1))
ACTOR = "asset:/Game/customer/899::actor::0"
query("refs_out_depth3", f"RECURSIVE WITH {_walk_sql(ACTOR, False, 3)} {SHOWN.format('out', 'w_out')} ORDER BY depth, r.id LIMIT 200", "entities", "edges")(lambda p: graph.references(p.entities, p.edges, ACTOR, "out", 3))
query(
    "refs_both_filtered",
    f"RECURSIVE WITH {_walk_sql(CUSTOMER, True, 2)}, {_walk_sql(CUSTOMER, False, 2)} SELECT * FROM ({SHOWN.format('in', 'w_in')} UNION ALL {SHOWN.format('out', 'w_out')} WHERE r.id NOT IN (SELECT id FROM w_in_rows)) x WHERE kind = 'asset' ORDER BY depth, direction, id LIMIT 100",
    "entities", "edges",
)(lambda p: graph.references(p.entities, p.edges, CUSTOMER, "both", 2, kind="asset", limit=100))
query("refs_edge_type", f"RECURSIVE WITH {_walk_sql(PART, True, 2, 'uses-material')} {SHOWN.format('in', 'w_in')} ORDER BY depth, r.id LIMIT 200", "entities", "edges")(lambda p: graph.references(p.entities, p.edges, PART, "in", 2, "uses-material"))

WEIGHTS = "CASE via " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items()) + " ELSE 1 END"
IMPACTED = f"SELECT r.id, kind, name, depth, via, round({WEIGHTS} / depth, 6) AS severity FROM w_in_rows r JOIN entities e ON e.id = r.id ORDER BY depth, r.id LIMIT 5000"
query("impact_depth4", f"RECURSIVE WITH {_walk_sql(NATION, True, 4)} SELECT * FROM ({IMPACTED}) x ORDER BY severity DESC, depth, id LIMIT 200", "entities", "edges")(lambda p: graph.impact(p.entities, p.edges, NATION))
query("impact_by_kind", f"RECURSIVE WITH {_walk_sql(NATION, True, 4)} SELECT kind, count(*) AS n FROM ({IMPACTED}) x GROUP BY kind", "entities", "edges")(lambda p: graph.impact_by_kind(p.entities, p.edges, NATION))
query("impact_summary", f"RECURSIVE WITH {_walk_sql(NATION, True, 4)} SELECT least(count(*), 5000) AS total_dependents, least(count(*), 5000) > 200 AS truncated FROM ({IMPACTED}) x", "entities", "edges")(lambda p: graph.impact_summary(p.entities, p.edges, NATION, 4))
query("entity_truncated", f"SELECT part, n, '5 of ' || CAST(n AS STRING) || ' listed' AS note FROM (SELECT 'children' AS part, count(*) AS n FROM entities WHERE parent = '{NATION}' UNION ALL SELECT 'incoming', count(*) FROM edges WHERE dst = '{NATION}' UNION ALL SELECT 'outgoing', count(*) FROM edges WHERE src = '{NATION}' UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE entity_id = '{NATION}') x WHERE n > 5", "entities", "edges", "chunks")(lambda p: graph.truncated(graph.entity_counts(p.entities, p.edges, p.chunks, NATION), 5))
query("subtree_closure", f"RECURSIVE WITH s AS (SELECT '{REGION}' AS id UNION SELECT e.id FROM s JOIN entities e ON e.parent = s.id) SELECT id FROM s", "entities")(lambda p: graph.subtree(p.entities, p.entities.where(F.col("id") == REGION)))
query(
    "ancestor_resolution",
    "RECURSIVE WITH b AS (SELECT DISTINCT id AS node, parent AS base FROM entities WHERE parent IS NOT NULL AND kind = 'asset'), n AS (SELECT node FROM b UNION SELECT base FROM b), a AS (SELECT node, node AS ancestor, 0 AS hops FROM n UNION SELECT a.node, b.base, a.hops + 1 FROM a JOIN b ON b.node = a.ancestor) SELECT node, ancestor, min(hops) AS hops FROM a GROUP BY ALL",
    "entities",
)(lambda p: graph.ancestors(p.entities.where("kind = 'asset'").select(F.col("id").alias("node"), F.col("parent").alias("base"))))

WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
query("tokenize_words", f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_words, CAST(len(list_distinct({WORDS.format('text')})) AS BIGINT) AS n_distinct FROM documents")(lambda p: p.table("documents").withColumn("w", word_tokens(F.col("text"))).select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct")))
CAMEL = r"regexp_replace(regexp_replace({0}, '([^\p{{Lu}} ])(\p{{Lu}})', '\1 \2', 'g'), '([^\p{{Lu}} ])(\p{{Lu}})', '\1 \2', 'g')"
query("camel_split", f"SELECT p_partkey, {CAMEL.format("'BP_' || p_type || 'OfPart' || CAST(p_partkey AS STRING) || 'XBox'")} AS words FROM part")(lambda p: p.table("part").select("p_partkey", split_camel(F.concat(F.lit("BP_"), F.col("p_type"), F.lit("OfPart"), F.col("p_partkey").cast("string"), F.lit("XBox"))).alias("words")))
_SPLIT = f"""list_transform(list_filter(list_transform({WORDS.format("translate(entity_id, '/:', '  ') || ' ' || left(split_part(text, chr(10), 1), 200)")}, lambda w: {{'w': w, 's': trim({CAMEL.format("replace(w, '_', ' ')")})}}), lambda p: p.s <> p.w AND p.s <> ''), lambda p: p.s)"""
AUX = f"SELECT id, coalesce(array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 24), ' '), '') AS aux FROM (SELECT id, {_SPLIT} AS l FROM chunks) s"
query("aux_tokens", AUX, "chunks")(lambda p: p.chunks.select("id", "aux"))
query("term_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) t GROUP BY term")(lambda p: p.table("documents").select("doc_id", F.explode(F.array_distinct(index_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))


def _documents(p: Project, aux: bool = False) -> search.Texts:
    """The texts of the documents, without or with their source as second column."""
    own = F.col("source") if aux else F.lit(None).cast("string")
    return search.Texts(p.spread("documents").select(F.concat(F.lit("c:"), F.col("doc_id").cast("string")).alias("id"), "text", own.alias("aux")))


def _count_sql(column: str, word: str, mode: str) -> str:
    """How often a list of terms has a word; one with underscores is a phrase, in `prefix` the last part is a beginning."""
    parts = word.split("_")
    test = lambda x, w, last: f"starts_with({x}, '{w}')" if mode == "prefix" and last else f"{x} = '{w}'"
    if "|" in word:  # the forms of one stem
        return f"len(list_filter({column}, lambda x: x IN ({', '.join(repr(w) for w in word.split('|'))})))"
    if len(parts) == 1:
        return f"len(list_filter({column}, lambda x: {test('x', word, True)}))"
    each = " AND ".join(test(f"{column}[i + {k}]", w, k == len(parts) - 1) for k, w in enumerate(parts))
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: coalesce({each}, false)))"


def _bm25(words: list[str], mode: str, aux: bool = False, source: str = "SELECT 'c:' || CAST(doc_id AS STRING) AS chunk_id, {0} AS t, {1} AS a FROM documents") -> str:
    source = source.format(TERMS.format("text"), TERMS.format("source") if aux else "CAST([] AS VARCHAR[])")
    tf = [f"{_count_sql('t', w, mode)} + 0.6 * {_count_sql('a', w, mode)} AS tf{i}" for i, w in enumerate(words)]
    part = "CASE WHEN tf{0} > 0 THEN greatest(ln((n - df{0} + 0.5) / (df{0} + 0.5)), 1e-6) * tf{0} * 2.2 / (tf{0} + 1.2 * (0.25 + 0.75 * length / mean_length)) ELSE 0 END"
    hit = " AND ".join if mode == "and" else " OR ".join
    return f"b AS (SELECT chunk_id, len(t) + len(a) AS length, {', '.join(tf)} FROM ({source}) src), s AS (SELECT count(*) AS n, avg(length) AS mean_length, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(len(words)))} FROM b), ranked AS (SELECT chunk_id, -({' + '.join(part.format(i) for i in range(len(words)))}) AS score FROM b, s WHERE {hit(f'tf{i} > 0' for i in range(len(words)))})"


def _top(ranked: DataFrame) -> DataFrame:
    return ranked.select("chunk_id", F.round("score", 6).alias("score")).orderBy("score", "chunk_id").limit(20)


TOP = "SELECT chunk_id, round(score, 6) AS score FROM ranked ORDER BY 2, 1 LIMIT 20"
query("bm25_and", f"WITH {_bm25(['achkeit', 'und'], 'and')} {TOP}")(lambda p: _top(search.rank_chunks(_documents(p), "Achkeit und", "and")))
query("bm25_or", f"WITH {_bm25(['achung', 'achein', 'erre'], 'or')} {TOP}")(lambda p: _top(search.rank_chunks(_documents(p), "achung achein erre", "or")))
query("bm25_prefix", f"WITH {_bm25(['achk', 'ciónad'], 'prefix')} {TOP}")(lambda p: _top(search.rank_chunks(_documents(p), "achk ciónad", "prefix")))
query("bm25_weighted_columns", f"WITH {_bm25(['src7', 'erre'], 'or', True)} {TOP}")(lambda p: _top(search.rank_chunks(_documents(p, True), "src7 erre", "or")))

query("bm25_phrase", f"WITH {_bm25(['the_of', 'and'], 'and')} {TOP}")(lambda p: _top(search.rank_chunks(_documents(p), "The_of and", "and")))
query("bm25_phrase_prefix", f"WITH {_bm25(['of_th', 'ciónad'], 'prefix')} {TOP}")(lambda p: _top(search.rank_chunks(_documents(p), "of_th ciónad", "prefix")))
query("bm25_prefix_keys", f"WITH {_bm25(['ac', 'tho'], 'prefix')} {TOP}")(lambda p: _top(search.rank_chunks(_documents(p), "ac tho", "prefix")))

# The SQL of full searches builds the auxiliary column as aux_tokens does.
_CHUNK_TERMS = f"SELECT chunks.id AS chunk_id, {TERMS.format('text')} AS t, regexp_extract_all(lower(array_to_string(list_slice(list_transform(list_filter(list_transform({WORDS.format("translate(entity_id, '/:', '  ') || ' ' || left(split_part(text, chr(10), 1), 200)")}, lambda w: {{'w': w, 's': trim({CAMEL.format("replace(w, '_', ' ')")})}}), lambda p: p.s <> p.w AND p.s <> ''), lambda p: p.s), 1, 100000), ' ')), '[\\p{{L}}\\p{{N}}]+') AS a FROM chunks"
BULK = "('Texture2D', 'TextureCube', 'Texture2DArray', 'VirtualTexture2D', 'MaterialInstanceConstant', 'MaterialFunction')"
HITS = f"owned AS (SELECT r.chunk_id, e.id, e.kind, e.name, e.path, c.kind AS chunk_kind, r.score * CASE e.kind WHEN 'level-actor' THEN 0.35 ELSE 1.0 END * CASE c.kind WHEN 'cpp-body' THEN 0.7 ELSE 1.0 END * CASE WHEN json_extract_string(e.detail, '$.assetClass') IN {BULK} THEN 0.5 ELSE 1.0 END AS score FROM ranked r JOIN chunks c ON c.id = r.chunk_id JOIN entities e ON e.id = c.entity_id), best AS (SELECT * FROM owned QUALIFY row_number() OVER (PARTITION BY id ORDER BY score, chunk_id) = 1)"


def _hits_sql(words: list[str], mode: str = "and") -> str:
    return "WITH " + _bm25(words, mode, source=_CHUNK_TERMS.replace("{", "{{").replace("}", "}}")) + ", " + HITS


def _hits(p: Project, words: str, mode: str = "and", **filters) -> DataFrame:
    return search.best_page(search.rank_chunks(search.Texts(p.chunks), words, mode), p.entities, p.chunks, 20, digits=6, **filters)


_SHOW = "SELECT id, kind, chunk_id, round(score, 6) AS score FROM best {0} ORDER BY 4, 1 LIMIT 20"
_shown = lambda d: d.select("id", "kind", "chunk_id", F.round("score", 6).alias("score")).orderBy("score", "id").limit(20)
query("search_best_chunk", _hits_sql(["ring"]) + _SHOW.format(""), "entities", "chunks")(lambda p: _shown(_hits(p, "ring")))
query("search_demotion", _hits_sql(["urgent", "promo"], "or") + _SHOW.format(""), "entities", "chunks")(lambda p: _shown(_hits(p, "urgent promo", "or")))
query("search_kind_path", _hits_sql(["ring", "small"], "or") + _SHOW.format("WHERE kind = 'asset' AND (starts_with(lower(id), 'asset:/game/part/1') OR starts_with(lower(path), '/game/part/1'))"), "entities", "chunks")(lambda p: _shown(_hits(p, "ring small", "or", kind="asset", path_prefix="/Game/part/1")))
_NAME = f"lower(name || ' ' || {CAMEL.format("replace(name, '_', ' ')")})"
RERANKED = f"fetched AS (SELECT *, (SELECT count(*) FROM edges WHERE dst = best.id) AS inbound FROM best ORDER BY score, id LIMIT 60), final AS (SELECT id, kind, name, round(score * (1 + 0.8 * ((CASE WHEN contains({_NAME}, 'small') THEN 1 ELSE 0 END + CASE WHEN contains({_NAME}, 'ring') THEN 1 ELSE 0 END) / 2.0)) * (1 + 0.12 * log2(1.0 + inbound)), 6) AS score, chunk_id, chunk_kind, inbound FROM fetched)"


def _search(p: Project, words: str, **filters) -> DataFrame:
    return search.search(search.Texts(p.chunks), p.entities, p.edges, p.chunks, words, **filters)


query("search_rerank", f"{_hits_sql(['small', 'ring'])}, {RERANKED} SELECT * FROM final ORDER BY score, id LIMIT 20", "entities", "edges", "chunks")(lambda p: _search(p, "small ring"))
# The second and the third tier: no chunk has both words; no chunk has either, but some have words that begin so.
_NAMED = lambda *words: RERANKED.replace("'small'", f"'{words[0]}'").replace("'ring'", f"'{words[-1]}'")
query("search_any_word", f"{_hits_sql(['steel', 'urgent'], 'or')}, {_NAMED('steel', 'urgent')} SELECT * FROM final ORDER BY score, id LIMIT 20", "entities", "edges", "chunks")(lambda p: _search(p, "steel urgent"))
query("search_beginnings", f"{_hits_sql(['urge', 'orde'], 'prefix')}, {_NAMED('urge', 'orde')} SELECT * FROM final ORDER BY score, id LIMIT 20", "entities", "edges", "chunks")(lambda p: _search(p, "urge orde"))
_STEMS = [f"{w}|{w}s|{w}ed|{w}ing|{w}ings|{w}e|{w}es" for w in ("order", "ring")]  # forms that end in what stemming takes off
query("search_stemmed", f"WITH {_bm25(_STEMS, 'and', source=_CHUNK_TERMS.replace('{', '{{').replace('}', '}}'))} {TOP}", "chunks")(lambda p: _top(search.rank_chunks(search.Texts(p.chunks, True), "orders rings", "and")))
_WORDS_AT = "SELECT chunk_id, list_transform(w, lambda x: CASE WHEN len(list_intersect(" + TERMS.format("x") + ", ['achung', 'achein'])) > 0 THEN '[' || x || ']' ELSE x END) AS m FROM (SELECT chunk_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM top JOIN documents ON chunk_id = 'c:' || CAST(doc_id AS VARCHAR)) y"
query(
    "search_snippet",
    f"""WITH {_bm25(['achung', 'achein'], 'or')}, top AS ({TOP}), m AS ({_WORDS_AT}), f AS (SELECT chunk_id, m, greatest(coalesce(list_position(list_transform(m, lambda x: starts_with(x, '[')), true), 0), 1) AS first FROM m), g AS (SELECT chunk_id, m, greatest(first - 4, 1) AS start FROM f)
    SELECT chunk_id, CASE WHEN start > 1 THEN '... ' ELSE '' END || array_to_string(m[start:start + 11], ' ') || CASE WHEN len(m) > start + 11 THEN ' ...' ELSE '' END AS snippet FROM g""",
)(lambda p: search.snippets(_top(search.rank_chunks(_documents(p), "achung achein", "or")), p.chunks.select(F.concat(F.lit("c:"), F.substring_index("entity_id", ":", -1)).alias("id"), "text", "kind").where("kind = 'doc-section' and text is not null"), "achung achein").select("chunk_id", "snippet"))
_SEEDS = f"""{_hits_sql(['small', 'ring'])}, {RERANKED.replace('LIMIT 60', 'LIMIT 72')}, page AS (SELECT * FROM final ORDER BY score, id LIMIT 24), turns AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY score, id) > 2 THEN 1 ELSE 0 END AS late FROM page), seeds AS (SELECT id, kind, name FROM turns ORDER BY late, score, id LIMIT 8)"""
query(
    "explain_bundle",
    f"""{_SEEDS}, near AS (SELECT src AS seed, dst AS id FROM edges UNION SELECT dst, src FROM edges), around AS (SELECT seed, id FROM near WHERE seed IN (SELECT id FROM seeds) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY id) <= 200), fresh AS (SELECT id, min(seed) AS seed FROM around WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id)
    SELECT 'seed' AS role, id, kind, name, id AS seed FROM seeds UNION ALL SELECT 'neighbour', e.id, e.kind, e.name, f.seed FROM fresh f JOIN entities e ON e.id = f.id""",
    "entities", "edges", "chunks",
)(lambda p: search.explain(search.Texts(p.chunks), p.entities, p.edges, p.chunks, "small ring"))

ATTRS = """'{{"confidence":"{0}","via":"' || {1} || '"}}'"""
query(
    "link_explicit",
    rf"""WITH n AS (SELECT DISTINCT e.id AS src, unnest(regexp_extract_all(text, '((?:asset|cpp|config):[A-Za-z0-9_/:.#-]*[A-Za-z0-9_])')) AS dst FROM entities e JOIN chunks c ON c.entity_id = e.id WHERE e.kind IN ('document', 'doc-section')) SELECT src, dst, 'describes' AS type, {ATTRS.format('explicit', "'id'")} AS attrs FROM n WHERE dst IN (SELECT id FROM entities) AND src <> dst""",
    "entities", "chunks",
)(lambda p: intent.explicit_links(p.entities, p.chunks))
query(
    "link_inferred",
    rf"""WITH t AS (SELECT name AS word, id AS dst FROM entities WHERE kind NOT IN ('document', 'doc-section', 'image') AND length(name) >= 5 AND (contains(name, '_') OR (length(regexp_replace(name, '[^\p{{Lu}}]', '', 'g')) >= 2 AND regexp_matches(name, '\p{{Ll}}')))), r AS (SELECT * FROM t WHERE word IN (SELECT word FROM t GROUP BY word HAVING count(*) <= 3)), w AS (SELECT DISTINCT e.id AS src, unnest({WORDS.format('text')}) AS word FROM entities e JOIN chunks c ON c.entity_id = e.id WHERE e.kind IN ('document', 'doc-section', 'image')) SELECT src, dst, 'describes' AS type, {ATTRS.format('inferred', 'min(word)')} AS attrs FROM w JOIN r USING (word) GROUP BY src, dst""",
    "entities", "chunks",
)(lambda p: intent.inferred_links(p.entities, p.chunks))


def _with_links(p: Project) -> DataFrame:
    return intent.explicit_links(p.entities, p.chunks)


query(
    "coverage",
    """WITH l AS (SELECT DISTINCT 'doc:order/' || CAST(o_orderkey AS STRING) || '#note' AS id FROM orders WHERE o_orderkey % 2000 IN (SELECT p_partkey FROM part)), s AS (SELECT e.parent AS doc, e.name, l.id IS NOT NULL AS linked FROM entities e LEFT JOIN l ON l.id = e.id WHERE kind = 'doc-section')
    SELECT e.id AS doc, json_extract_string(detail, '$.docType') AS doc_type, count(s.doc) AS n_sections, count(s.doc) FILTER (WHERE linked) AS n_linked, coalesce(string_agg(s.name, '|' ORDER BY s.name) FILTER (WHERE NOT linked), '') AS missing FROM entities e LEFT JOIN s ON s.doc = e.id WHERE kind = 'document' GROUP BY ALL ORDER BY doc LIMIT 500""",
    "entities",
)(lambda p: intent.coverage(p.entities, _with_links(p)))


@query(
    "drift",
    """WITH n AS (SELECT 'doc:order/' || CAST(o_orderkey AS STRING) || '#note' AS src, 'asset:/Game/customer/' || CAST(o_custkey AS STRING) || '::actor::' || CAST(o_orderkey AS STRING) AS dst, CAST(CAST(o_totalprice + o_orderkey % 2 AS DECIMAL(18,2)) AS STRING) AS stated, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS actual FROM orders)
    SELECT src, dst, 'o_totalprice' AS key, CAST(CAST(stated AS DOUBLE) AS DOUBLE) AS stated, CAST(actual AS DOUBLE) AS actual FROM n WHERE abs(CAST(stated AS DOUBLE) - CAST(actual AS DOUBLE)) > 1e-6 ORDER BY src, dst LIMIT 200""",
)
def _drift(p: Project) -> DataFrame:
    told = p.table("orders").select(F.concat(F.lit("doc:order/"), F.col("o_orderkey").cast("string"), F.lit("#note")).alias("src"), F.concat(F.lit("asset:/Game/customer/"), F.col("o_custkey").cast("string"), F.lit("::actor::"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("describes").alias("type"))
    found = intent.drift(p.entities, told, p.chunks)
    return found.withColumns({c: F.col(c).cast("double") for c in ("stated", "actual")})


@query(
    "link_brand",
    """WITH i AS (SELECT 'image:' || CAST(page_id AS STRING) AS src FROM pages WHERE page_id % 25 = 0), g AS (SELECT 'doc:' || CAST(doc_id AS STRING) AS dst FROM documents WHERE source = 'src7') SELECT src, dst, 'illustrates' AS type, '{"confidence":"inferred","via":"brand"}' AS attrs FROM i, g""",
)
def _link_brand(p: Project) -> DataFrame:
    images = p.table("pages").select(F.concat(F.lit("image:"), F.col("page_id").cast("string")).alias("id"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("detail"), F.when(F.col("page_id") % 25 == 0, "the new Logo").otherwise("a tree").alias("text"))
    guides = p.table("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("document").alias("kind"), F.to_json(F.struct(F.when(F.col("source") == "src7", "brand-guidelines").otherwise("other").alias("docType"))).alias("detail"))
    chunks = images.select(F.concat(F.lit("c:"), F.col("id")).alias("id"), F.col("id").alias("entity_id"), "text")
    return intent.brand_links(images.drop("text").unionByName(guides), chunks)


def _html_sql() -> str:
    out = "html"
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"(?is)<head.*?</head>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    for level in range(1, 7):
        out = f"regexp_replace(regexp_replace({out}, '(?i)<h{level}[^>]*>', chr(10) || '{'#' * level} ', 'g'), '(?i)</h{level}>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)<(br|/p|/div|/li|/tr|/section|/article|/header|/footer|/table|/ul|/ol)[^>]*>', chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '<[^>]+>', '', 'g')"
    out = f"regexp_replace({out}, '(?i)&nbsp;', chr(32), 'g')"
    for name, code in (("amp", 38), ("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("mdash", 0x2014), ("ndash", 0x2013)):
        out = f"regexp_replace({out}, '(?i)&{name};', chr({code}), 'g')"
    return f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


query("html_to_text", f"SELECT page_id, {_html_sql()} AS text FROM pages")(lambda p: p.table("pages").select("page_id", html_to_text(F.col("html")).alias("text")))
query("html_title", "SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&quot;', '\"')) AS title FROM pages")(lambda p: p.table("pages").select("page_id", html_title(F.col("html")).alias("title")))
