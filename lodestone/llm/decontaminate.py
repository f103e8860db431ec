"""Benchmark decontamination by template windows, with DataFrame functions only.

A text becomes a sequence of template words: lower-case words without punctuation, in which numbers, units after numbers
and names (capitalised words within a sentence) are typed placeholders. Windows of template words are hash-joined with
those of the benchmark items; where they hold placeholders, the values that stand in one alignment of document and item
must map each value of the item to one value of the document. So a question that was asked again with other numbers or
names is found, and a chance agreement of templates is not.

Beside them stand windows of the plain lower-case words at the same places, without placeholders and with no least number
of literals, so that verbatim copies are found whatever their case, spacing and place in a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, without_ids

#: Words of a window, and of the shorter windows at every STEP-th place that find the documents to look into: each run of
#: WINDOW words holds one of them (SEED + STEP - 1 <= WINDOW).
WINDOW, SEED, STEP = 8, 6, 3
#: A document is contaminated by an item of whose words this share is found, or of which one alignment holds so many
#: windows (13 words and more); template windows need so many words that aren't placeholders.
COVERAGE, LONG_RUN, LITERALS = 0.5, 6, 4
#: Bytes of item windows, and ids of documents to look into (16 bytes each), that may be broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 1_000_000

NUMBER, UNIT, NAME, MARK = "\ue000", "\ue001", "\ue002", "\ue003"  # letters for private use; MARK stands before a name
MARKS = f"array('{NUMBER}', '{UNIT}', '{NAME}')"
# Units of measure and money that stand after numbers.
UNITS = "kg|g|mg|t|lb|lbs|oz|km|m|cm|mm|nm|mi|mile|miles|ft|feet|foot|inch|inches|yd|yards|l|ml|cl|liter|liters|litre|litres|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|month|months|year|years|kmh|mph|hz|khz|mhz|ghz|w|kw|mw|kwh|v|a|j|kj|n|pa|kpa|bar|k|c|f|degrees|percent|%|usd|eur|gbp|dollars|dollar|cents|cent|euros|euro|pounds|pound|kilometers|kilometres|meters|metres|meter|metre|grams|gram|kilograms|kilogram|tons|tonnes|kb|mb|gb|tb"


def _marked(text: Column) -> Column:
    """Lower case with names marked, decimal signs joined and units cut off their numbers; no word is lost or joined."""
    named = F.regexp_replace(text, r"([\p{L}\p{N},;:)]\s++)(?=\p{Lu}\p{Ll})", "$1" + MARK)
    low = F.lower(named)
    numbers = F.regexp_replace(F.regexp_replace(low, "(?<=[0-9])[.,:/](?=[0-9])", "_"), r"([0-9])(?=[\p{L}%])", "$1 ")
    return F.when(low.rlike("[0-9]"), numbers).otherwise(low)


def _templated(marked: Column) -> Column:
    """The marked text with placeholders, word for word."""
    numbers = F.regexp_replace(marked, r"(?<![\p{L}\p{N}_%])[0-9][0-9_]*+(?![\p{L}%])", NUMBER)
    units = F.regexp_replace(numbers, rf"(?<={NUMBER} )(?:{UNITS})(?![\p{{L}}\p{{N}}_%])", UNIT)
    out = F.when(marked.rlike("[0-9]"), units).otherwise(marked)
    return F.when(out.contains(MARK), F.regexp_replace(out, rf"{MARK}[\p{{L}}\p{{N}}_]++", NAME)).otherwise(out)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"[^\p{{L}}\p{{N}}_%{NUMBER}{UNIT}{NAME}{MARK}]+"), "")


def _unmarked(marked: Column) -> Column:
    return F.translate(marked, MARK, "")


def _hashed(words: str) -> str:
    return f"transform({words}, x -> xxhash64(x))"


def _window(hashes: str, at: str, k: int, how: str = "xxhash64") -> str:
    """One hash of the k words from place `at` (from 0), given their hashes: single elements are read, since a slice of
    an array costs as much as the whole array."""
    return f"{how}({', '.join(f'{hashes}[{at} + {j}]' for j in range(k))})"


def _windows(hashes: str, k: int, step: int = 1) -> str:
    return f"if(size({hashes}) >= {k}, transform(sequence(0, size({hashes}) - {k}, {step}), i -> {_window(hashes, 'i', k)}), cast(array() as array<bigint>))"


def template_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with t (template words), r (marked words) and p (plain words), of one length."""
    marked = df.withColumn("_m", _marked(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    words = marked.withColumn("t", _words(_templated(F.col("_m")))).withColumn("r", _words(F.col("_m")))
    return words.withColumn("p", _words(_unmarked(F.col("_m")))).drop("_m")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each pair of a contaminated document and an item: doc_id, item_id, n_windows (different windows of the
    item that were found), coverage (share of the item's words in them), longest (windows of the best alignment) and
    reworded (whether a placeholder's value differs).

    All documents are reduced to SEED-word windows (template and plain) at every STEP-th word and semi-joined with those of the items; the
    documents that have one get all their WINDOW-word windows, so none is lost. Items with fewer words than a window are
    one window of their own length. Items' windows and the ids of documents found are broadcast only if they are few.

    Null texts are empty and never match, nor do items without words; rows with a null id are left out; rows of one
    document id are read as one document, repeated rows add nothing; other columns are ignored."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null")
    items = template_words(items).where("size(t) > 0").withColumn("k", F.least(F.size("t"), F.lit(WINDOW)))
    # An item's sentence starts may be names within a document's sentence, and its names may be written small there.
    capital = _words(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace("text", r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{N}_%])", MARK), "(?<=[0-9])[.,:/](?=[0-9])", "_")), r"([0-9])(?=[\p{L}%])", "$1 "))
    items = items.withColumn("c", capital)
    raised = F.expr(f"if(size(c) = size(t), transform(t, (y, i) -> if(y = p[i] and startswith(c[i], '{MARK}'), '{NAME}', y)), t)")
    lowered = F.expr(f"transform(t, (y, i) -> if(y = '{NAME}', p[i], y))")
    variants = F.array_distinct(F.array(*[F.struct(w.alias("t"), F.col("r").alias("r"), F.lit(False).alias("plain")) for w in (F.col("t"), raised, lowered)], F.struct(F.col("p").alias("t"), F.col("p").alias("r"), F.lit(True).alias("plain"))))
    each = items.select("item_id", F.size("t").alias("words"), "k", F.explode(variants).alias("y")).select("item_id", "words", "k", "y.*")
    each = each.withColumn("q", F.expr(_hashed("t")))
    own = None
    lengths = sorted(r["k"] for r in each.select("k").distinct().collect())  # WINDOW at most
    for k in lengths:
        made = f"transform(sequence(1, size(t) - {k} + 1), i -> named_struct('at', i, 'h1', {_window('q', 'i - 1', k)}, 'h2', {_window('q', 'i - 1', k, 'hash')}, 'w', slice(t, i, {k}), 'q', slice(q, i, {k}), 'v', transform(slice(r, i, {k}), y -> translate(y, '{MARK}', ''))))"
        part = each.where(F.col("k") == k).select("item_id", "words", "k", "plain", F.explode(F.expr(made)).alias("x"))
        own = part if own is None else own.unionByName(part)
    if own is None:
        return docs.sparkSession.createDataFrame([], f"doc_id long, item_id {dict(items.dtypes)['item_id']}, n_windows long, coverage double, longest long, reworded boolean")
    each = own
    each = each.select("item_id", "words", "k", "plain", "x.*").where(F.expr(f"plain or size(filter(w, y -> not array_contains({MARKS}, y))) >= least({LITERALS}, k)"))
    # Where a window has no placeholder, its plain copy is enough.
    each = each.where(F.expr(f"plain or arrays_overlap(w, {MARKS})")).dropDuplicates(["item_id", "k", "at", "h1", "h2"])
    windows = materialize(each, "item-windows")
    size = F.expr("160 + 8 * size(q) + 16 * (size(w) + size(v)) + octet_length(concat_ws('', w, v))")
    few = (windows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    small = F.broadcast if few else lambda frame: frame

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    lean = rows.withColumn("_m", _marked(F.coalesce("text", F.lit(""))))
    lean = lean.select("doc_id", _words(_templated(F.col("_m"))).alias("t"), _words(_unmarked(F.col("_m"))).alias("p"))
    lean = lean.select("doc_id", F.expr(_hashed("t")).alias("t"), F.expr(_hashed("p")).alias("p"))
    seeds = windows.where(f"k = {WINDOW}").select(F.explode(F.expr(f"transform(sequence(0, {WINDOW - SEED}), i -> {_window('q', 'i', SEED)})")).alias("h")).unionByName(windows.where(f"k < {WINDOW}").select(F.col("h1").alias("h"))).distinct()
    made = [_windows(w, SEED, STEP) for w in "tp"] + [_windows(w, k) for k in lengths if k < WINDOW for w in "tp"]
    hashes = F.array_distinct(F.expr(f"concat({', '.join(made)})"))
    met = materialize(lean.select("doc_id", F.explode(hashes).alias("h")).join(small(seeds), "h", "left_semi").select("doc_id").distinct(), "met")
    near = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met

    looked = template_words(rows.join(near, "doc_id", "left_semi"))
    looked = materialize(looked.select("doc_id", "t", F.expr(f"transform(r, y -> translate(y, '{MARK}', ''))").alias("r"), F.expr(_hashed("t")).alias("a"), F.expr(_hashed("p")).alias("b")), "looked-into")
    looked = looked.withColumn("marked", F.expr(f"transform(t, y -> array_contains({MARKS}, y))"))
    found = None
    for k in lengths:
        values = f"array({', '.join(f'r[i + {j}]' for j in range(k))})"
        slots = f"if({' or '.join(f'marked[i + {j}]' for j in range(k))}, {values}, null)"
        made = [f"transform(sequence(0, size(a) - {k}), i -> named_struct('plain', {plain}, 'place', i + 1, 'h1', {_window(w, 'i', k)}, 'h2', {_window(w, 'i', k, 'hash')}, 'u', {u}))" for w, plain, u in (("a", "false", slots), ("b", "true", "cast(null as array<string>)"))]
        own = looked.where(F.size("a") >= k).select("doc_id", F.explode(F.expr(f"concat({', '.join(made)})")).alias("x")).select("doc_id", "x.*")
        hit = own.join(small(windows.where(F.col("k") == k).drop("q")), ["plain", "h1", "h2"]).select("doc_id", "item_id", "words", "k", "at", "w", (F.col("place") - F.col("at")).alias("shift"), F.expr("if(u is null, null, v)").alias("v"), "u")
        found = hit if found is None else found.unionByName(hit)
    found = materialize(found, "window-matches")

    line = ["doc_id", "item_id", "shift"]
    values = found.where("u is not null").select(*line, F.explode(F.arrays_zip("w", "v", "u")).alias("x")).where(F.expr(f"array_contains({MARKS}, x.w)"))
    values = values.groupBy(*line, F.col("x.w").alias("kind"), F.col("x.v").alias("asked")).agg(F.min("x.u").alias("low"), F.max("x.u").alias("high"))
    checked = values.groupBy(*line).agg(F.max(F.col("low") != F.col("high")).alias("torn"), F.max((F.col("low") != F.col("asked")) | (F.col("high") != F.col("asked"))).alias("other"))
    sound = found.join(checked, line, "left").where(F.col("u").isNull() | ~F.coalesce("torn", F.lit(False)))
    lines = sound.groupBy(*line).agg(F.countDistinct("at").alias("windows"), F.max(F.coalesce("other", F.lit(False))).alias("other"))
    best = lines.groupBy("doc_id", "item_id").agg(F.max("windows").alias("longest"), F.max("other").alias("reworded"))
    words = sound.select("doc_id", "item_id", "words", "at", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("word"))
    cover = words.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("n_windows"), (F.countDistinct("word") / F.max("words")).alias("coverage"))
    return cover.join(best, ["doc_id", "item_id"]).where((F.col("coverage") >= COVERAGE) | (F.col("longest") >= LONG_RUN)).select("doc_id", "item_id", "n_windows", "coverage", "longest", "reworded")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that an item contaminates. Rows with a null id stay."""
    found = find_contamination(docs, benchmark, id_col, text_col)
    return without_ids(docs, found.select(F.col("doc_id").alias(id_col)), id_col)
