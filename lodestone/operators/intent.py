"""Documents against what they describe: links, coverage, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_distinctive, word_tokens
from ..schema import INTENT_KINDS
from .lineage import settle

ID_PATTERN = r"((?:asset|cpp|config):[A-Za-z0-9_/:.#-]*[A-Za-z0-9_])"
MOST_TARGETS = 3


def intent_texts(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, kind, detail, text of documents, sections and images; without chunks the text is empty."""
    own = entities.where(F.col("kind").isin(*INTENT_KINDS)).select("id", "kind", "detail")
    return own.join(chunks.select(F.col("entity_id").alias("id"), "text"), "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def explicit_links(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst, type, attrs: ids that a text of a document names and that exist."""
    named = intent_texts(entities, chunks).where("kind <> 'image'").select(F.col("id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ID_PATTERN), F.lit(1)))).alias("dst")).distinct()
    found = named.join(entities.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst")
    return found.select("src", "dst", F.lit("describes").alias("type"), F.to_json(F.struct(F.lit("explicit").alias("confidence"), F.lit("id").alias("via"))).alias("attrs"))


def inferred_links(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst, type, attrs: distinctive names, of MOST_TARGETS entities at most, that a text has as a whole word."""
    # Only distinctive words can be such a name. Names are looked up in the vocabulary of the texts, not in the texts: a word
    # that stands in every text and names nothing goes before any text is joined, and a name is counted only if it stands somewhere.
    odd = lambda w: (F.length(w) >= 5) & w.rlike(r"_|\p{Lu}.*\p{Lu}") & is_distinctive(w)  # noqa: E731  most words fail the cheap tests
    words = settle(chunks.select(F.col("entity_id").alias("src"), F.explode_outer(F.filter(F.array_distinct(word_tokens(F.col("text"))), odd)).alias("word")).where("word is not null"))
    vocabulary = settle(words.select("word").distinct())
    named = entities.where(~F.col("kind").isin(*INTENT_KINDS)).where(is_distinctive(F.col("name"))).select(F.col("name").alias("word"), F.col("id").alias("dst"))
    targets = settle(named.join(vocabulary, "word", "left_semi"))
    rare = targets.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_TARGETS).select("word")
    met = words.join(settle(targets.join(rare, "word", "left_semi")), "word").where("src <> dst")
    found = met.join(entities.where(F.col("kind").isin(*INTENT_KINDS)).select(F.col("id").alias("src"), "kind"), "src")
    out = found.groupBy("src", "dst").agg(F.min("word").alias("word"), F.min("kind").alias("kind"))
    return out.select("src", "dst", F.when(F.col("kind") == "image", "illustrates").otherwise("describes").alias("type"), F.to_json(F.struct(F.lit("inferred").alias("confidence"), F.col("word").alias("via"))).alias("attrs"))


def brand_links(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst: images whose text speaks of a brand or logo, with each brand guideline; joined on the document type."""
    images = intent_texts(entities, chunks).where("kind = 'image'").where(F.col("text").rlike("(?i)brand|logo")).select(F.col("id").alias("src"), F.lit("brand-guidelines").alias("doc_type")).distinct()
    guides = entities.where("kind = 'document'").select(F.col("id").alias("dst"), F.get_json_object("detail", "$.docType").alias("doc_type"))
    return images.join(guides, "doc_type").select("src", "dst", F.lit("illustrates").alias("type"), F.to_json(F.struct(F.lit("inferred").alias("confidence"), F.lit("brand").alias("via"))).alias("attrs"))


def build_links(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """All links; an explicit one wins over an inferred one of the same ends."""
    found = explicit_links(entities, chunks).withColumn("turn", F.lit(0))
    found = found.unionByName(inferred_links(entities, chunks).withColumn("turn", F.lit(1))).unionByName(brand_links(entities, chunks).withColumn("turn", F.lit(2)))
    return found.groupBy("src", "dst").agg(F.min_by(F.struct("type", "attrs"), "turn").alias("x")).select("src", "dst", "x.type", "x.attrs")


def coverage(entities: DataFrame, edges: DataFrame, doc_type: str = "", limit: int | None = 500) -> DataFrame:
    """For each document: n_sections, n_linked (with a describes edge) and missing (names of the others, joined); all of them
    (None) in no order."""
    linked = edges.where("type = 'describes'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    sections = entities.where("kind = 'doc-section'").select("id", "name", F.col("parent").alias("doc")).join(linked, "id", "left")
    by_doc = sections.groupBy("doc").agg(F.count("*").alias("n_sections"), F.count("links").alias("n_linked"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("links").isNull(), F.col("name")))), "|").alias("missing"))
    docs = entities.where("kind = 'document'").select(F.col("id").alias("doc"), F.get_json_object("detail", "$.docType").alias("doc_type"))
    if doc_type:
        docs = docs.where(F.lower("doc_type") == doc_type.lower())
    found = docs.join(by_doc, "doc", "left").select("doc", "doc_type", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("missing", F.lit("")).alias("missing"))
    return found if limit is None else found.orderBy("doc").limit(limit)


def coverage_summary(entities: DataFrame, edges: DataFrame, doc_type: str = "") -> DataFrame:
    """One row over all documents, whatever the limit of the list."""
    return coverage(entities, edges, doc_type, None).agg(F.count("*").alias("documents"), F.sum("n_sections").alias("sections"), F.sum("n_linked").alias("linked"))


def six_digits(number: Column) -> Column:
    """A number as C prints it with %g: six significant digits without trailing zeros, with an exponent below -4 and from 6. Halves
    of the shortest decimal form go up."""
    told = F.format_string("%.5e", number)
    power = F.regexp_extract(told, "e([+-][0-9]+)$", 1).cast("int")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when((power < -4) | (power >= 6), F.concat(bare(F.substring_index(told, "e", 1)), F.regexp_extract(told, "e.*$", 0))).otherwise(bare(told.cast("decimal(38,12)").cast("string")))


def scalar_text(value: Column, six: bool = True) -> Column:
    """A scalar of a VARIANT as text: whole numbers without a fraction, others with six digits (or all of theirs); null for
    objects, arrays, nulls and empty texts."""
    kind, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    whole = F.abs(number - F.round(number)) <= 1e-8
    told = (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("string"))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.when(whole, F.round(number).cast("decimal(20,0)").cast("string")).otherwise(six_digits(number) if six else F.try_variant_get(value, "$", "string")))
    )
    return F.nullif(told, F.lit(""))


def json_scalars(rows: DataFrame, column: str, six: bool = True) -> DataFrame:
    """rows with key and value for each top-level scalar of the JSON object in `column`; texts that aren't objects have
    none."""
    parsed = rows.withColumn("_object", F.try_parse_json(column)).where(F.schema_of_variant("_object").startswith("OBJECT"))
    each = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_object").outer()))
    return each.withColumn("value", scalar_text(F.col("value"), six)).where("value is not null").drop("_object", "pos")


def values_differ(a, b):
    """Numbers by value, other texts without case."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) > 1e-6).otherwise(F.lower(a) != F.lower(b))


def drift(entities: DataFrame, edges: DataFrame, chunks: DataFrame, limit: int | None = 200, six: bool = False) -> DataFrame:
    """Where a section's text states key = value or key: value of what it describes, and the value differs: src, dst, key,
    stated, actual. Of several section chunks of one source, the one with the smallest id speaks. In order up to the limit;
    all of them (None) come in no order, since one task would hold them.

    With `six`, actual numbers are taken as they are shown, with six digits, so that a longer one that is stated exactly
    counts as different too."""
    texts = chunks.where("kind = 'doc-section'").groupBy(F.col("entity_id").alias("src")).agg(F.min_by("text", "id").alias("text"))
    detailed = entities.where("detail is not null").select(F.col("id").alias("dst"), "detail")
    detailed = detailed.join(edges.where("type = 'describes'").select("dst").distinct(), "dst", "left_semi")
    detailed = detailed.repartition("dst")  # JSON costs much for its bytes: the tasks of a small file would be few
    facts = json_scalars(detailed, "detail", six).select("dst", "key", F.col("value").alias("actual")).where(F.length("key") >= 3)
    told = edges.where("type = 'describes'").select("src", "dst").distinct().join(texts, "src").join(facts, "dst").where(F.contains(F.lower("text"), F.lower("key")))
    stated = F.expr(r"regexp_extract(text, concat('(?i)\\Q', key, '\\E[ \\t]*[=:][ \\t]*([\\p{L}\\p{N}._#-]+)'), 1)")
    found = told.withColumn("stated", stated).where((F.col("stated") != "") & values_differ(F.col("stated"), F.col("actual"))).select("src", "dst", "key", "stated", "actual")
    return found if limit is None else found.orderBy("src", "dst", "key").limit(limit)
