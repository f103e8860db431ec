"""Document parsers: one document gives many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_to_text, one_line, slug, split_camel

MOST_SECTIONS, MOST_CHARS = 400, 8000
HEADING = r"^\s*(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"

# Words of a path by document type, in the order in which they are tried; names of files only where marked.
DOC_TYPES = (
    ("brand-guidelines", "path", "brand|logo|styleguide|style-guide|style_guide|visual-identity|visual identity"),
    ("art-bible", "path", "artbible|art-bible|art_bible|art bible|art-style|art-direction|artdirection"),
    ("audio-design", "path", "audio|sound|music|sfx|wwise|fmod"),
    ("onboarding", "file", "readme|contributing|onboarding|setup|getting-started|getting_started"),
    ("onboarding", "path", "coding-standard|coding_standard|code-style|conventions"),
    ("accessibility", "path", "accessibility|a11y"),
    ("ratings-compliance", "path", "esrb|pegi|rating|cert|compliance|age-rating"),
    ("legal", "path", "legal|license|licence|eula|privacy|attribution|third-party|thirdparty"),
    ("marketing", "path", "marketing|pitch|press|store-page|storepage|trailer|key-art|keyart|messaging"),
    ("localization", "path", "localization|localisation|loc-|/loc/|glossary|i18n|l10n"),
    ("dialogue-script", "path", "dialogue|dialog|vo-script|vo_script|voiceover|barks"),
    ("narrative", "path", "narrative|lore|story|worldbuild|world-build|character-bio|characters|bible"),
    ("ux-ui", "path", "ux|/ui/|ui-|-ui|wireframe|hud|menu-flow|user-flow|userflow"),
    ("level-design", "path", "level-design|leveldesign|level_design|/levels/|/level/|layout|whitebox|greybox|blockout|beat-chart|pacing|encounter|lighting"),
    ("technical-design", "path", "tdd|technical-design|technical_design|architecture|tech-design|systems-design"),
    ("postmortem", "path", "postmortem|post-mortem|retro"),
    ("qa-test", "path", "qa|test-plan|testplan|triage|bug"),
    ("production", "path", "roadmap|milestone|sprint|production|schedule|backlog"),
    ("meeting-notes", "path", "meeting|adr|decision-record|notes"),
    ("game-design", "path", "gdd|game-design|game_design|design-doc|designdoc|feature-design|mechanic|one-pager|onepager|design"),
)
# First folders of a path in which images are read.
IMAGE_ROOTS = ("documentation", "docs", "art", "reference", "references", "concept", "conceptart", "design", "brand", "branding", "marketing", "ux", "ui")


def classify_document(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """The type of a document by its relative path: prefixes of `overrides` first, then the first rule that fits."""
    rel = F.translate(path, "\\", "/")
    low = F.lower(rel)
    file = F.element_at(F.split(low, "/"), -1)
    out = F.lit("other")
    for kind, where, words in reversed(DOC_TYPES):
        out = F.when((file if where == "file" else low).rlike(words), kind).otherwise(out)
    for prefix, kind in reversed(list((overrides or {}).items())):
        out = F.when(rel.startswith(prefix), kind).otherwise(out)
    return out


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (doc and other columns) exploded to line_no (from 0) and line."""
    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def markdown_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc, section (from 0), level, heading, body of Markdown texts (doc, text).

    Text before the first heading is a section of level 0 if it isn't blank; a text without headings is one such section.
    Sections beyond MOST_SECTIONS of a document are left out, bodies are cut at MOST_CHARS."""
    lines = lines_of(docs.select("doc", text_col), text_col)
    marks = F.regexp_extract("line", HEADING, 1)
    title = F.regexp_extract("line", HEADING, 2)
    order = Window.partitionBy("doc").orderBy("line_no")
    tagged = lines.withColumn("level", F.length(marks)).withColumn("is_heading", (F.length(marks) > 0).cast("int")).withColumn("part", F.sum("is_heading").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_heading") == 0, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = tagged.groupBy("doc", "part").agg(F.max("level").alias("level"), F.max(F.when(F.col("is_heading") == 1, title)).alias("heading"), F.trim(body).alias("body"))
    parts = parts.where((F.col("part") > 0) | ~F.col("body").rlike(r"^\s*$"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("part")) - 1
    return parts.withColumn("section", place).where(F.col("section") < MOST_SECTIONS).select("doc", "section", "level", F.coalesce("heading", F.lit("")).alias("heading"), F.left("body", F.lit(MOST_CHARS)).alias("body"))


def section_slugs(sections: DataFrame) -> DataFrame:
    """sections with slug: unique in a document; the second of one base is base-2 and so on. A base that would meet a
    numbered one is told apart by the same count, so no two are equal."""
    base = F.when(F.col("level") == 0, "overview").otherwise(slug(F.col("heading")))
    named = sections.withColumn("base", base)
    turn = F.row_number().over(Window.partitionBy("doc", "base").orderBy("section"))
    numbered = named.withColumn("slug", F.when(turn == 1, F.col("base")).otherwise(F.concat_ws("-", "base", turn.cast("string"))))
    again = F.row_number().over(Window.partitionBy("doc", "slug").orderBy(F.col("slug") != F.col("base"), "section"))
    return numbered.withColumn("again", again).withColumn("slug", F.when(F.col("again") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "again", "section"))).drop("base", "again")


def html_sections(pages: DataFrame) -> DataFrame:
    """markdown_sections of pages (doc, html)."""
    return markdown_sections(pages.select("doc", html_to_text(F.col("html")).alias("text")))


# How a document is read, by the extension of its file.
FORMATS = {"markdown": ("md", "markdown", "mdx"), "html": ("html", "htm"), "rtf": ("rtf",), "text": ("txt", "rst", "text", "log"), "docx": ("docx",), "pdf": ("pdf",)}


def format_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return reduce(lambda out, kv: F.when(extension.isin(*kv[1]), kv[0]).otherwise(out), FORMATS.items(), F.lit("unsupported"))


def rtf_to_text(rtf: Column) -> Column:
    """Text of RTF: paragraph words are line feeds, other control words, escapes and braces go."""
    out = F.regexp_replace(rtf, r"\\(?:par|line|pard)\b ?", "\n")
    out = F.regexp_replace(out, r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "")
    out = F.regexp_replace(out, r"\\'[0-9a-fA-F]{2}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\\[a-zA-Z]+-?[0-9]* ?", ""), r"[{}]", ""))


def document_rows(files: DataFrame, source: str = "", overrides: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and chunks of documents (rel, text): one entity and overview chunk each, and one for each section."""
    prefix = f"{source}:" if source else ""
    kept = files.where(~F.col("rel").startswith("Plugins/")).withColumn("format", format_of(F.col("rel"))).where("format <> 'unsupported'")
    text = F.when(F.col("format") == "html", html_to_text(F.col("text"))).when(F.col("format") == "rtf", rtf_to_text(F.col("text"))).otherwise(F.col("text"))
    docs = kept.select(F.concat(F.lit(f"{prefix}doc:"), F.col("rel")).alias("doc"), "rel", text.alias("text")).where("text is not null and trim(text) <> ''")
    sections = section_slugs(markdown_sections(docs)).withColumn("id", F.concat_ws("#", "doc", "slug"))
    first = sections.where("level = 1").groupBy("doc").agg(F.min_by("heading", "section").alias("title"))
    tops = docs.join(first, "doc", "left").select(F.col("doc").alias("id"), F.lit("document").alias("kind"), F.coalesce("title", F.element_at(F.split("rel", "/"), -1)).alias("name"), F.col("rel").alias("path"), F.lit(None).cast("string").alias("parent"), F.to_json(F.struct(classify_document(F.col("rel"), overrides).alias("docType"))).alias("detail"), F.left("text", F.lit(MOST_CHARS)).alias("text"))
    parts = sections.join(docs.select("doc", "rel"), "doc").select("id", F.lit("doc-section").alias("kind"), F.when(F.col("heading") == "", F.col("slug")).otherwise(F.col("heading")).alias("name"), F.col("rel").alias("path"), F.col("doc").alias("parent"), F.to_json(F.struct("level")).alias("detail"), F.col("body").alias("text"))
    rows = tops.unionByName(parts)
    entities = rows.select("id", "kind", "name", "path", "parent", F.lit("doc").alias("source"), F.lit(None).cast("string").alias("summary"), "detail", F.lit("docs@1").alias("producer"), F.lit("stated-intent").alias("authority"))
    chunks = rows.select(F.concat(F.lit("chunk:"), F.col("id")).alias("id"), F.col("id").alias("entity_id"), F.when(F.col("kind") == "document", "doc-overview").otherwise("doc-section").alias("kind"), "text")
    return entities, chunks


def parse_ini(files: DataFrame) -> DataFrame:
    """rel, section, key, value, line_no of ini texts (rel, text); comments and keys outside of sections are left out."""
    lines = lines_of(files.select(F.col("rel").alias("doc"), "text")).withColumn("line", F.trim("line"))
    lines = lines.where(~F.col("line").rlike("^[;#]") & (F.col("line") != ""))
    name = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    tagged = lines.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), name), True).over(Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    keys = tagged.where(F.col("section").isNotNull() & F.col("line").rlike(r"^[^=\[][^=]*=|^\[[^=]*[^\]=]="))
    return keys.select(F.col("doc").alias("rel"), "section", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("value"), "line_no")


def is_stale_config(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return base.contains(" - Copy") | F.lower(base).contains("backup")


def plugins(manifests: DataFrame) -> DataFrame:
    """rel, plugin, enabled of project manifests (rel, text)."""
    parsed = F.from_json("text", "Plugins array<struct<Name:string,Enabled:boolean>>")
    return manifests.select("rel", F.explode(parsed["Plugins"]).alias("p")).select("rel", F.col("p.Name").alias("plugin"), F.coalesce("p.Enabled", F.lit(True)).alias("enabled"))


def image_tags(path: Column) -> Column:
    """Tags of an image by its path: words of its names, two characters and more, in lower case, and `image`."""
    bare = F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/_-.", "    ")
    words = F.filter(F.split(F.lower(split_camel(bare)), r"\s+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(words, F.array(F.lit("image"))))


def under_image_root(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", 1)).isin(*IMAGE_ROOTS) & path.contains("/")


def caption(text: Column) -> Column:
    return one_line(text)
