"""Queries over documents, extractors, storage and the change feed; each with its SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets, code, markup, store
from ..operators.store import Snapshot
from ..schema import validate
from ..sources import files
from ..sources.projection import Project
from ..streaming import changes
from .core import CAMEL, SQL, _html_sql, query

PAGE_TEXT = f"SELECT page_id AS doc, {_html_sql()} AS text FROM pages"


def _page_sections(p: Project) -> DataFrame:
    return markup.html_sections(p.table("pages").select(F.col("page_id").alias("doc"), "html"))


@query(
    "markdown_sections",
    rf"""WITH t AS ({PAGE_TEXT}), l AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
    h AS (SELECT *, length(regexp_extract(line, '^\s*(#{{1,6}})[ \t]+(.*?)[ \t]*#*[ \t]*$', 1)) AS mark, regexp_extract(line, '^\s*(#{{1,6}})[ \t]+(.*?)[ \t]*#*[ \t]*$', 2) AS title FROM l),
    p AS (SELECT *, sum(CASE WHEN mark > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS part FROM h),
    s AS (SELECT doc, part, max(mark) AS level, coalesce(max(title) FILTER (WHERE mark > 0), '') AS heading, trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE mark = 0), ''), ' ') AS body FROM p GROUP BY ALL)
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY part) - 1 AS INTEGER) AS section, CAST(level AS INTEGER) AS level, heading, left(body, 8000) AS body FROM s WHERE part > 0 OR NOT regexp_full_match(body, '\s*')""",
)
def _markdown(p: Project) -> DataFrame:
    return _page_sections(p)


_BASE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(heading), '[ _-]+', '-', 'g'), '[^\p{L}\p{N}-]+', '', 'g'), '-{2,}', '-', 'g'), '-')"
query(
    "section_slugs",
    f"""WITH m AS ({SQL['markdown_sections']}), b AS (SELECT doc, section, CASE WHEN level = 0 THEN 'overview' WHEN {_BASE} = '' THEN 'section' ELSE {_BASE} END AS base FROM m),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY section) AS turn FROM b), s AS (SELECT doc, section, base, CASE WHEN turn = 1 THEN base ELSE base || '-' || CAST(turn AS VARCHAR) END AS slug FROM n),
    a AS (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY slug <> base, section) AS again FROM s)
    SELECT doc, section, CASE WHEN again = 1 THEN slug ELSE slug || '-' || CAST(again AS VARCHAR) || '-' || CAST(section AS VARCHAR) END AS slug FROM a""",
)(lambda p: markup.section_slugs(_page_sections(p)).select("doc", "section", "slug"))


def _rules() -> str:
    out = "'other'"
    for kind, where, words in reversed(markup.DOC_TYPES):
        text = "regexp_extract(lower(url), '[^/]*$')" if where == "file" else "lower(url)"
        out = f"CASE WHEN regexp_matches({text}, '{words}') THEN '{kind}' ELSE {out} END"
    return out


URL = "regexp_replace(url, '^https?://', '')"
query("doc_type_classify", f"SELECT page_id, {_rules()} AS doc_type FROM pages")(lambda p: p.table("pages").select("page_id", markup.classify_document(F.col("url")).alias("doc_type")))
query(
    "image_tags",
    f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append(list_filter(string_split_regex(lower({CAMEL.format("translate(regexp_replace('art/' || replace(p_name, ' ', '_') || '/' || p_type || 'Icon.png', '\\.[^./]+$', ''), '/_-.', '    ')")}), '\\s+'), lambda w: length(w) >= 2), 'image'))), ' ') AS tags FROM part",
)(lambda p: p.table("part").select("p_partkey", F.array_join(F.array_sort(markup.image_tags(F.concat(F.lit("art/"), F.translate("p_name", " ", "_"), F.lit("/"), F.col("p_type"), F.lit("Icon.png")))), " ").alias("tags")))


@query("ini_sections", "SELECT 'config/' || CAST(n_nationkey AS STRING) || '.ini' AS rel, section, key, value FROM nation, (VALUES ('/Script/Nation', 'Name'), ('/Script/Nation', '+Region'), ('Limits', 'Most')) k(section, key), LATERAL (SELECT CASE key WHEN 'Name' THEN n_name WHEN '+Region' THEN 'r=' || CAST(n_regionkey AS STRING) ELSE '10' END AS value) v")
def _ini(p: Project) -> DataFrame:
    text = F.concat(F.lit("Lost=1\r\n; a comment\r\n[/Script/Nation]\r\nName = "), F.col("n_name"), F.lit("\r\n+Region=r="), F.col("n_regionkey").cast("string"), F.lit("\r\n=none\r\n\r\n[Limits]\r\n# another\r\nMost=10"))
    return markup.parse_ini(p.table("nation").select(F.concat(F.lit("config/"), F.col("n_nationkey").cast("string"), F.lit(".ini")).alias("rel"), text.alias("text"))).drop("line_no")


@query("upsert_latest", "SELECT id, name, producer FROM (SELECT CAST(user_id AS STRING) AS id, event_type AS name, 'p' || CAST(event_id % 3 AS STRING) AS producer, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) x WHERE r = 1")
def _upsert_latest(p: Project) -> DataFrame:
    rows = p.table("events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("producer"), F.col("event_id").alias("seq"))
    return store.latest(rows, ["id"], "seq").drop("seq")


def _state(p: Project) -> Snapshot:
    return Snapshot(p.entities, p.edges, p.chunk_rows)


def _delta(p: Project) -> Snapshot:
    """Every third customer again under another name, with one edge, and no chunks."""
    own = p.table("customer").where("c_custkey % 3 = 0")
    id = F.concat(F.lit("asset:/Game/customer/"), F.col("c_custkey").cast("string"))
    entities = own.select(id.alias("id"), F.lit("asset").alias("kind"), F.concat(F.lit("New "), F.col("c_name")).alias("name"), F.lit("/new").alias("path"), F.lit("asset").alias("source"))
    edges = own.select(id.alias("src"), F.lit("asset:/Game/region/0").alias("dst"), F.lit("references").alias("type"))
    return Snapshot(validate(entities, "entities"), validate(edges, "edges"), p.chunk_rows.limit(0))


def _shown(state: Snapshot) -> DataFrame:
    """Counts by table and producer, and a digest of the ids."""
    out = []
    for table, id in (("entities", F.col("id")), ("edges", F.concat_ws(">", "src", "type", "dst")), ("chunks", F.col("id"))):
        keyed = getattr(state, table).select(F.coalesce("producer", F.lit("-")).alias("producer"), F.conv(F.substring(F.md5(id.cast("binary")), 1, 8), 16, 10).cast("long").alias("h"))
        out.append(keyed.groupBy("producer").agg(F.count("*").alias("n"), F.sum("h").alias("digest")).withColumn("part", F.lit(table)))
    return store.union_all(out)


_HASH = "CAST(sum(CAST('0x' || left(md5({0}), 8) AS BIGINT)) AS BIGINT)"
_SHOW = " UNION ALL ".join(f"SELECT coalesce(producer, '-') AS producer, count(*) AS n, {_HASH.format(i)} AS digest, '{t}' AS part FROM {f} GROUP BY 1" for t, f, i in (("entities", "e2", "id"), ("edges", "g2", "src || '>' || type || '>' || dst"), ("chunks", "c2", "id")))
_NEW = "d AS (SELECT 'asset:/Game/customer/' || CAST(c_custkey AS STRING) AS id FROM customer WHERE c_custkey % 3 = 0)"
_ADDED = "SELECT id, 'assets@1' AS producer FROM d", "SELECT id AS src, 'references' AS type, 'asset:/Game/region/0' AS dst, 'assets@1' AS producer FROM d"
query(
    "producer_replace",
    f"WITH {_NEW}, e2 AS (SELECT id, producer FROM entities WHERE producer <> 'assets@1' UNION ALL {_ADDED[0]}), g2 AS ({_ADDED[1]}), c2 AS (SELECT id, producer FROM (SELECT id, CAST(NULL AS STRING) AS producer FROM chunks) c) {_SHOW}",
    "entities", "chunks",
)(lambda p: _shown(store.ingest_producer(_state(p), "assets@1", _delta(p))))
_TREE = "t AS (SELECT id FROM d UNION SELECT e.id FROM t JOIN entities e ON e.parent = t.id)"
query(
    "producer_delta",
    f"RECURSIVE WITH {_NEW}, {_TREE}, e2 AS (SELECT id, producer FROM entities WHERE NOT (producer = 'assets@1' AND id IN (SELECT id FROM t)) UNION ALL {_ADDED[0]}), g2 AS (SELECT src, type, dst, producer FROM edges WHERE NOT (producer = 'assets@1' AND src IN (SELECT id FROM t)) UNION ALL {_ADDED[1]}), c2 AS (SELECT id, CAST(NULL AS STRING) AS producer FROM chunks) {_SHOW}",
    "entities", "edges", "chunks",
)(lambda p: _shown(store.patch_scoped(_state(p), _delta(p), "assets@1", _delta(p).entities.select("id"))))
query(
    "subtree_patch",
    f"RECURSIVE WITH {_NEW}, {_TREE}, e2 AS (SELECT id, producer FROM entities WHERE id NOT IN (SELECT id FROM t) UNION ALL {_ADDED[0]}), g2 AS (SELECT src, type, dst, producer FROM edges WHERE src NOT IN (SELECT id FROM t) UNION ALL {_ADDED[1]}), c2 AS (SELECT id, CAST(NULL AS STRING) AS producer FROM chunks WHERE entity_id NOT IN (SELECT id FROM t)) {_SHOW}",
    "entities", "edges", "chunks",
)(lambda p: _shown(store.patch(_state(p), _delta(p), "assets@1", _delta(p).entities.select("id"))))


@query(
    "signature_diff",
    "WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS sig FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS sig FROM orders WHERE o_orderkey % 3 <> 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.sig = n.sig AND n.sig <> '' THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id",
)
def _signatures(p: Project) -> DataFrame:
    rows = p.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("sig"))
    new = rows.withColumn("sig", F.when((F.col("id") % 5 == 0) & (F.col("sig") != ""), "x").otherwise(F.col("sig")))
    return store.diff_signatures(rows.where("id % 7 <> 0"), new.where("id % 3 <> 0"))


query("fingerprint", "SELECT md5(string_agg(l, chr(10) ORDER BY l)) AS fingerprint FROM (SELECT 'src/' || CAST(s_suppkey AS STRING) || '.cpp|' || CAST(s_nationkey AS STRING) || '|' || CAST(s_suppkey * 7 AS STRING) AS l FROM supplier) x")(lambda p: store.fingerprint(p.table("supplier").select(F.concat(F.lit("src/"), F.col("s_suppkey").cast("string"), F.lit(".cpp")).alias("path"), F.col("s_nationkey").alias("size"), (F.col("s_suppkey") * 7).alias("mtime"))))


def change_events(p: Project) -> DataFrame:
    """The event table as a change feed of packages."""
    package = F.concat(F.lit("/Game/u/"), F.col("user_id").cast("string"))
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("save")
    to = F.when(op == "rename", F.concat(package, F.lit("b"))).otherwise(package)
    return p.table("events").select(F.col("event_id").alias("seq"), "ts", op.alias("op"), to.alias("package"), F.when(op == "rename", package).alias("old_package"))


query(
    "change_feed_latest",
    "WITH e AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' ELSE 'save' END AS op, '/Game/u/' || CAST(user_id AS STRING) || CASE WHEN event_type = 'purchase' THEN 'b' ELSE '' END AS package FROM events UNION ALL SELECT event_id, 'delete', '/Game/u/' || CAST(user_id AS STRING) FROM events WHERE event_type = 'purchase') SELECT package, seq, op FROM e QUALIFY row_number() OVER (PARTITION BY package ORDER BY seq DESC, op DESC) = 1",
)(lambda p: changes.latest_changes(change_events(p)).select("package", "seq", "op"))


def _tagged(p: Project) -> DataFrame:
    package = F.concat(F.lit("/Game/part/"), F.col("p_partkey").cast("string"))
    tags = F.create_map(F.lit("Brand"), F.col("p_brand"), F.lit("FiBData"), F.lit("x"), F.lit("Material"), F.concat(F.lit("Material'/Game/mat/"), F.col("p_type"), F.lit("."), F.col("p_type"), F.lit("'")), F.lit("Size"), F.col("p_size").cast("string"))
    return p.table("part").select(package.alias("package"), tags.alias("tags"))


query("tag_summary", "SELECT 'asset:/Game/part/' || CAST(p_partkey AS STRING) AS id, 'Brand=' || p_brand || ', Material=' || p_type || ', Size=' || CAST(p_size AS STRING) AS text FROM part")(lambda p: assets.tag_summary(_tagged(p))[0])
query("tag_references", "SELECT DISTINCT 'asset:/Game/part/' || CAST(p_partkey AS STRING) AS src, 'asset:/Game/mat/' || p_type AS dst, 'references' AS type FROM part")(lambda p: assets.tag_summary(_tagged(p))[1].select("src", "dst", "type"))


@query(
    "config_property_diff",
    "WITH x AS (SELECT 'o' || CAST(o_custkey AS STRING) AS owner, 'P' || CAST(o_orderkey AS STRING) AS prop, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'F'), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY prop) AS place FROM x) SELECT owner, string_agg(prop || '=' || value, ', ' ORDER BY place) AS text FROM r WHERE place <= 28 GROUP BY owner",
)
def _properties(p: Project) -> DataFrame:
    rows = p.table("orders").select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("owner"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("prop"), F.col("o_orderstatus").alias("value"), F.lit("F").alias("default_value"), F.lit(None).cast("string").alias("ref_package"))
    return assets.property_diff(rows)[0]


query("timing_history", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")(lambda p: store.keep_newest(p.table("events").select("user_id", "event_id"), "event_id", 3, "user_id"))

# A harbour: what a lighthouse keeper calls, in the shapes that the call graph tells apart.
HEADER = """UCLASS(NotPlaceable)
class HARBOUR_API A{0}Lighthouse : public ATower
{
    UPROPERTY(VisibleAnywhere, Category = "Optics; lenses")
    TObjectPtr<ALantern> MainLantern;
    UFUNCTION(BlueprintPure)
    float NightRange(float Fog) const;
    UFUNCTION() void Signal(int32 Flashes);
    /* UFUNCTION() void Demolish(); */
};
UCLASS() class ATower : public AStructure { UFUNCTION() void Climb(); UFUNCTION() void Inspect(); };
UCLASS() class ALantern : public AStructure { UFUNCTION() void Ignite(); UFUNCTION() void Dim(); };
"""
SOURCE = """float A{0}Lighthouse::NightRange(float Fog) const
{
    const TCHAR* Note = TEXT("Climb() by hand");
    return Fog > 0.5f ? 1.0f : 9.0f;
}
void A{0}Lighthouse::Signal(int32 Flashes)
{
    for (int32 i = 0; i < Flashes; ++i) { MainLantern->Ignite(); MainLantern->Dim(); }
    NightRange(0.1f);
    Super::Inspect(); // then Climb()
    Stranger->Ignite();
    Input->BindAction(SignalAction, ETriggerEvent::Triggered, this, &A{0}Lighthouse::Signal);
}
"""


def _code(p: Project, text: str, suffix: str) -> DataFrame:
    name = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
    return p.table("region").select(F.concat(name, F.lit(suffix)).alias("file"), F.replace(F.lit(text), F.lit("{0}"), name).alias("text"))


_KNOWN = [f"AR{i}Lighthouse" for i in range(5)]
query("cpp_classes")(lambda p: code.classes(_code(p, HEADER, ".h")))
query("cpp_bodies")(lambda p: code.bodies(_code(p, SOURCE, ".cpp"), _KNOWN))
query("cpp_bindings")(lambda p: code.bindings(_code(p, SOURCE, ".cpp")))
query("cpp_calls")(lambda p: code.calls(code.bodies(_code(p, SOURCE, ".cpp"), _KNOWN), code.classes(_code(p, HEADER, ".h"))))


@query("graph_pseudocode")
def _pseudocode(p: Project) -> DataFrame:
    """Each customer's orders as a chain that starts with an event."""
    own = p.table("orders").select(F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("graph"), F.col("o_orderkey").cast("string").alias("node"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("seq"))
    from pyspark.sql import Window

    by = Window.partitionBy("graph").orderBy("seq")
    linked = own.withColumn("next", F.lead("node").over(by)).withColumn("is_event", F.row_number().over(by) == 1)
    pins = linked.select("graph", "node", F.lit("then").alias("pin"), F.lit("out").alias("dir"), F.lit(True).alias("is_exec"), F.col("next").alias("linked_node"), F.lit("").alias("default_value"), "seq")
    return assets.render_graphs(linked.select("graph", "node", "title", "is_event", "seq"), pins)


query("rtf_text")(lambda p: p.table("nation").select("n_nationkey", markup.rtf_to_text(F.concat(F.lit(r"{\rtf1\ansi{\fonttbl\f0 Arial;}\f0 Land: "), F.col("n_name"), F.lit(r"\par end}"))).alias("text")))


def _packed(p: Project, make, suffix: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch.assign(content=[make(n) for n in batch["n_name"]]).drop(columns="n_name")

    named = p.table("nation").select(F.concat("n_name", F.lit(suffix)).alias("rel"), "n_name")
    return files.with_text(named.mapInPandas(run, "rel string, content binary"))


def sample_docx(text: str) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">a &amp; </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def sample_pdf(text: str) -> bytes:
    import zlib

    body = zlib.compress(f"BT /F1 12 Tf 10 700 Td ({text}) Tj 0 -14 Td [(sec) -20 (ond)] TJ ET".encode("latin-1"))
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n"


query("docx_text")(lambda p: _packed(p, sample_docx, ".docx"))
query("pdf_text")(lambda p: _packed(p, sample_pdf, ".pdf"))
