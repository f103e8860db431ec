"""Ranked text search over chunks: BM25 with column weights, demotions, best chunk of an entity, re-ranking, tiers, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import index_terms, query_terms, spaced_terms, split_camel, terms_in, times_in
from ..schema import BULK_CLASSES, DEMOTED_CHUNK, DEMOTED_CLASS, DEMOTED_KIND
from .graph import links_at
from .lineage import cut, keep_rows

K1, B, TEXT_WEIGHT, AUX_WEIGHT, IDF_FLOOR = 1.2, 0.75, 1.0, 0.6, 1e-6
#: Candidates that are re-ranked: OVERFETCH times the page, MOST_FETCHED at most.
OVERFETCH, MOST_FETCHED = 3, 300


def stem(word: str) -> str:
    """Porter's suffix stripping (1980) of a lower-case word."""
    vowels = "aeiou"

    def consonant(i: int) -> bool:
        return word[i] not in vowels and not (word[i] == "y" and i > 0 and consonant(i - 1))

    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word

    def shape(s: str) -> str:
        out = ""
        for i, c in enumerate(s):
            mark = "v" if c in vowels or c == "y" and i > 0 and out[-1] == "c" else "c"
            out += mark
        return out

    def measure(s: str) -> int:
        return reduce(lambda n, pair: n + (pair == ("v", "c")), zip(shape(s), shape(s)[1:]), 0)

    def short_end(s: str) -> bool:
        return len(s) >= 3 and shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swap(w: str, pairs: tuple[tuple[str, str], ...], least: int) -> str:
        for end, new in sorted(pairs, key=lambda p: -len(p[0])):
            if w.endswith(end):
                head = w[: len(w) - len(end)]
                return head + new if measure(head) > least else w
        return w

    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    # The suffixes of the second to fourth step.
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in sorted(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), key=len, reverse=True):
        if w.endswith(end):
            head = w[: -len(end)]
            if measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def stem_dictionary(terms: DataFrame) -> DataFrame:
    """term, stem for each distinct term: stemming costs by vocabulary, not by text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=batch["term"].map(stem))

    return terms.select("term").distinct().mapInPandas(run, "term string, stem string")


#: Beginnings of terms that have merged postings of their own, in letters.
PREFIX_KEYS = (2, 3)
POSTINGS = "term string, chunk_id string, tf_text long, tf_aux long, text_at array<int>, aux_at array<int>"
PREFIXES = "key string, chunk_id string, tf_text long, tf_aux long"
LENGTHS = "chunk_id string, length int, sig long"


class Index:
    """The text index of chunks.

    postings: term, chunk_id, tf_text, tf_aux and the term's places in each column (read for phrases only).
    prefixes: the same counts, merged over all terms that begin with a key of 2 or 3 letters.
    lengths: chunk_id, length, sig (of what was indexed).
    All of it is lazy; save() writes postings sorted by term and prefixes sorted by key, so that a search reads few row
    groups of either."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, stemmed: bool = False, prefixes: DataFrame | None = None):
        self.postings, self.lengths, self.stemmed = postings, lengths, stemmed
        self.prefixes = _merged_prefixes(postings) if prefixes is None else prefixes

    @classmethod
    def build(cls, chunks: DataFrame, stemmed: bool = False) -> Index:
        aux = F.coalesce("aux", F.lit(""))
        terms = chunks.select(F.col("id").alias("chunk_id"), index_terms(F.col("text")).alias("t"), index_terms(aux).alias("a"), chunk_signature().alias("sig"))
        lengths = terms.select("chunk_id", (F.size("t") + F.size("a")).alias("length"), "sig")

        def tag(column: str, text: int) -> Column:
            return F.transform(column, lambda x, i: F.struct(x.alias("term"), F.lit(text).alias("text"), i.alias("at")))

        tagged = F.concat(tag("t", 1), tag("a", 0))
        flat = terms.select("chunk_id", F.explode(tagged).alias("x")).select("chunk_id", "x.*")
        places = lambda own: F.array_sort(F.collect_list(F.when(F.col("text") == own, F.col("at"))))
        counts = [F.sum("text").alias("tf_text"), F.sum(1 - F.col("text")).alias("tf_aux"), places(1).alias("text_at"), places(0).alias("aux_at")]
        postings = flat.groupBy("term", "chunk_id").agg(*counts)
        if stemmed:
            stems = stem_dictionary(postings.select("term"))
            both = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
            merged = [F.sum("tf_text").alias("tf_text"), F.sum("tf_aux").alias("tf_aux"), both("text_at"), both("aux_at")]
            postings = postings.join(stems, "term").groupBy(F.col("stem").alias("term"), "chunk_id").agg(*merged)
        return cls(postings, lengths, stemmed)

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        stored = self.postings.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
        _merged_prefixes(stored).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/prefixes")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str, stemmed: bool = False) -> Index:
        read = lambda part, schema: spark.read.schema(schema).parquet(f"{path}/{part}")
        return cls(read("postings", POSTINGS), read("lengths", LENGTHS), stemmed, read("prefixes", PREFIXES))

    def without(self, dead: DataFrame) -> Index:
        """The index without the chunks `dead` (chunk_id)."""
        drop = lambda df: df.join(dead, "chunk_id", "left_anti").select(*df.columns)
        return Index(drop(self.postings), drop(self.lengths), self.stemmed, drop(self.prefixes))

    @staticmethod
    def union(parts: list[Index]) -> Index:
        whole = lambda name: reduce(DataFrame.unionByName, [getattr(x, name) for x in parts])
        return Index(whole("postings"), whole("lengths"), parts[0].stemmed, whole("prefixes"))

    def phrases(self, query: str) -> list[tuple[str, ...]]:
        return _phrases(query, self.stemmed)


def _phrases(query: str, stemmed: bool) -> list[tuple[str, ...]]:
    """The words of a query as terms; a word that underscores part is a phrase of several, side by side in a text."""
    words = [query_terms(w, distinct=False) for w in re.findall(r"\w+", query)]
    return list(dict.fromkeys(tuple(map(stem, w)) if stemmed else tuple(w) for w in words if w))


def _overlaps(phrase: tuple[str, ...], begun: bool) -> bool:
    """Whether a place of the phrase can begin within another one."""

    def both(at: int, word: str) -> bool:
        return word.startswith(phrase[at]) if begun and at == len(phrase) - 1 else word == phrase[at]

    return any(all(both(by + i, phrase[i]) for i in range(len(phrase) - by)) for by in range(1, len(phrase)))


def _begins(stem: str) -> str:
    """What all words of a stem begin with: suffixes are taken off or replaced, two letters of the stem at most are new."""
    return stem[: max(1, len(stem) - 2)]


class Texts:
    """Chunks that are searched as they lie, for a single search of tables that have no stored index.

    A search passes over the texts once: it stores the counts of the chunks that have a phrase, and takes the totals of all
    chunks on the way; scores are made of these few columns. Where words are stemmed, it stores the words that begin as the
    stems do, as the forms of a stem are known only when all are seen. The answers are those of Index.build(chunks, stemmed).
    Ids are of one chunk each. Where chunks name their entity, ranked chunks carry entity_id and chunk_kind."""

    def __init__(self, chunks: DataFrame, stemmed: bool = False):
        self.chunks, self.stemmed = chunks, stemmed
        told = {"entity_id": F.col("entity_id"), "chunk_kind": F.col("kind")} if "entity_id" in chunks.columns else {}
        self.kept = list(told)
        self.lower = chunks.select(F.col("id").alias("chunk_id"), *[c.alias(name) for name, c in told.items()], F.lower("text").alias("text"), F.lower(F.coalesce(F.col("aux"), F.lit(""))).alias("aux"))

    def phrases(self, query: str) -> list[tuple[str, ...]]:
        return _phrases(query, self.stemmed)

    def terms(self, having: Column | None = None) -> DataFrame:
        """chunk_id, told (whether the chunk has a text), length and the spaced terms t and a of text and aux. With `having`
        terms are found only in chunks where it holds: no filter, since Spark would move it, and what it has to find, to
        the few tasks that read a table before it is dealt out."""
        ready = F.lit(True) if having is None else having
        rows = self.lower.withColumns({"t": F.when(ready, spaced_terms(F.col("text"))), "a": F.when(ready, spaced_terms(F.col("aux")))})
        # No length is null: Spark would filter by that below the terms, and find them again for each filter.
        return rows.select("chunk_id", *self.kept, F.col("text").isNotNull().alias("told"), F.coalesce(terms_in(F.col("t")) + terms_in(F.col("a")), F.lit(0)).alias("length"), "t", "a")

    def _counted(self, rows: DataFrame, phrases: list[tuple[str, ...]], modes: tuple[bool, ...], aux_weight: float, forms: dict[str, list[str]]) -> DataFrame:
        """terms() with how often the chunk has each phrase, weighted, for its terms: tf<mode>_<place>."""

        def same(x: Column, term: str, begun: bool) -> Column:
            return reduce(lambda a, b: a | b, [x.startswith(w) if begun else x == w for w in forms.get(term, [term])])

        def letters(spaced: str, term: str) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(F.col(spaced), F.lit(" " + w)) for w in forms.get(term, [term])])

        def times(spaced: str, phrase: tuple[str, ...], begun: bool) -> Column:
            def starts(x: Column, i: Column) -> Column:
                each = [same(F.get(terms, i + k), w, begun and k == len(phrase) - 1) for k, w in enumerate(phrase)]
                return reduce(lambda a, b: a & b, each)

            if len(phrase) == 1 and not begun:
                found = reduce(lambda a, b: a + b, [times_in(F.col(spaced), f" {w} ") for w in forms.get(phrase[0], list(phrase))])
            elif not self.stemmed and not _overlaps(phrase, begun):
                found = times_in(F.col(spaced), " " + "  ".join(phrase) + " " * (not begun))
            else:
                terms = F.split(F.trim(F.col(spaced)), "  ")
                found = F.size(F.filter(terms, starts))
            return F.when(reduce(lambda a, b: a & b, [letters(spaced, t) for t in phrase]), found).otherwise(0)

        tf = {f"tf{int(m)}_{i}": _weight(times("t", p, m), times("a", p, m), aux_weight) for m in modes for i, p in enumerate(phrases)}
        return rows.select("chunk_id", *self.kept, "told", "length", *[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in tf.items()])

    def counts(self, phrases: list[tuple[str, ...]], modes: tuple[bool, ...], aux_weight: float, forms: dict[str, list[str]], having: bool = False) -> DataFrame:
        """chunk_id, length and how often the chunk has each phrase, weighted: tf<mode>_<place>, of whole words (mode 0) and of
        beginnings (1). With `having` terms are found only in chunks that have the letters of a phrase's first word, as all matches do."""
        first = {w for p in phrases for w in forms.get(p[0], [p[0]])}
        ready = reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(w)) for text in ("text", "aux") for w in sorted(first)]) if having else None
        return self._counted(self.terms(ready), phrases, modes, aux_weight, forms)

    def _matches(self, phrases: list[tuple[str, ...]], modes: tuple[bool, ...], aux_weight: float) -> tuple[DataFrame, dict]:
        """counts() of the chunks that have a phrase; and of all chunks n, how many have a text, the sum of their lengths
        and, by tf column, how many have the phrase."""
        totals = {"n": F.count("*"), "texts": F.count_if(F.col("told")), "terms": F.sum(F.when(F.col("told"), F.col("length")))}
        columns = [f"tf{int(m)}_{i}" for m in modes for i in range(len(phrases))]
        df = {c: F.count_if(F.col(c) > 0) for c in columns}
        any_of = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in columns])
        if not self.stemmed:
            return keep_rows(self.counts(phrases, modes, aux_weight, {}), any_of, **totals, **df)
        stems = {t for p in phrases for t in p}
        rows, told = self._near(stems, whole=any(len(p) > 1 for p in phrases), totals=totals)
        found, having = keep_rows(self._counted(rows, phrases, modes, aux_weight, self._forms(stems, rows)), any_of, **df)
        return found, told | having

    def _near(self, stems: set[str], whole: bool, totals: dict[str, Column]) -> tuple[DataFrame, dict]:
        """terms() of the chunks with words that begin as the stems do: these words, or all where phrases need their places. Only
        words of letters a to z are changed by stemming, and keep most of the stem, so few others are among them."""
        exact = {s for s in stems if not re.fullmatch("[a-z]+", s)}
        heads = {_begins(s) for s in stems - exact}
        words = "|".join([f"(?:{'|'.join(sorted(heads))})[a-z]*"] * bool(heads) + sorted(map(re.escape, exact)))
        begun = lambda c: reduce(lambda a, b: a | b, [F.contains(F.col(c), F.lit(f" {w}")) for w in sorted(heads | exact)])
        near = lambda c: F.concat(F.lit("  "), F.array_join(F.regexp_extract_all(F.col(c), F.lit(f" ({words}) "), F.lit(1)), "  "), F.lit("  "))
        rows = self.terms()
        rows = rows.select(*[c for c in rows.columns if c not in "ta"], *[F.when(begun(c), F.col(c) if whole else near(c)).alias(c) for c in "ta"])
        return keep_rows(rows, F.col("t").isNotNull() | F.col("a").isNotNull(), **totals)

    def _forms(self, stems: set[str], rows: DataFrame) -> dict[str, list[str]]:
        """The terms of some chunks that have one of the stems; a stem has a bounded number of forms."""
        forms: dict[str, list[str]] = {s: [s] for s in stems if not re.fullmatch("[a-z]+", s)}
        heads = sorted({_begins(s) for s in stems - forms.keys()})
        if not heads:
            return forms
        near = F.lit(f" ((?:{'|'.join(heads)})[a-z]*) ")
        found = F.array_distinct(F.concat(*[F.coalesce(F.regexp_extract_all(F.col(c), near, F.lit(1)), F.array().cast("array<string>")) for c in "ta"]))
        for r in stem_dictionary(rows.select(F.explode(found).alias("term"))).where(F.col("stem").isin(*stems)).collect():
            forms.setdefault(r["stem"], []).append(r["term"])
        return forms

    def scores(self, phrases: list[tuple[str, ...]], modes: tuple[bool, ...], aux_weight: float = AUX_WEIGHT) -> DataFrame:
        """chunk_id, score<mode> (lower is better) and matched<mode> (phrases that the chunk has) of the chunks that match in
        any of `modes`."""
        found, told = self._matches(phrases, modes, aux_weight)
        mean = told["terms"] / told["texts"] if told.get("texts") else None
        rows, out = found.withColumns({"n": F.lit(told.get("n", 0)), "mean_length": F.lit(mean).cast("double")}), {}
        for m in map(int, modes):
            part = [_bm25(F.col(f"tf{m}_{i}"), F.lit(told.get(f"tf{m}_{i}", 0))) for i in range(len(phrases))]  # above 0 where tf is
            out[f"matched{m}"] = reduce(lambda a, b: a + b, [(x > 0).cast("int") for x in part])
            out[f"score{m}"] = -reduce(lambda a, b: a + b, part)
        scored = rows.select("chunk_id", *self.kept, *[c.alias(name) for name, c in out.items()])
        return scored.where(reduce(lambda a, b: a | b, [F.col(f"score{int(m)}") < 0 for m in modes]))


def chunk_signature() -> Column:
    """Of what the text index holds of a chunk."""
    return F.xxhash64("text", F.coalesce("aux", F.lit("")))


def _merged_prefixes(postings: DataFrame) -> DataFrame:
    keys = F.array(*[F.left("term", F.lit(n)) for n in PREFIX_KEYS])
    keyed = postings.select(F.explode(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min(PREFIX_KEYS)))).alias("key"), "chunk_id", "tf_text", "tf_aux")
    return keyed.groupBy("key", "chunk_id").agg(F.sum("tf_text").alias("tf_text"), F.sum("tf_aux").alias("tf_aux"))


def document_frequencies(index: Index) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def _weight(text: Column, aux: Column, aux_weight: float) -> Column:
    return TEXT_WEIGHT * text + aux_weight * aux


def _one_term(index: Index, words: list[str], prefix: bool, aux_weight: float) -> list[DataFrame]:
    """word, chunk_id, tf of single terms; of prefixes the terms that begin with them count together."""
    tf = _weight(F.col("tf_text"), F.col("tf_aux"), aux_weight).alias("tf")
    if not prefix:
        return [index.postings.where(F.col("term").isin(*words)).select(F.col("term").alias("word"), "chunk_id", tf)] if words else []
    keyed, ranged = [w for w in words if len(w) in PREFIX_KEYS], [w for w in words if len(w) not in PREFIX_KEYS]
    out = [index.prefixes.where(F.col("key").isin(*keyed)).select(F.col("key").alias("word"), "chunk_id", tf)] if keyed else []
    if ranged:
        hit = reduce(lambda a, b: a | b, [F.col("term").startswith(w) for w in ranged])
        named = F.array_compact(F.array(*[F.when(F.col("term").startswith(w), F.lit(w)) for w in ranged]))
        out.append(index.postings.where(hit).select(F.explode(named).alias("word"), "chunk_id", tf))
    return out


def _phrase(index: Index, phrases: list[tuple[str, ...]], prefix: bool, aux_weight: float) -> list[DataFrame]:
    """word, chunk_id, tf of phrases: the places of their terms, each less its place in the phrase, meet in one column. With
    `prefix` the last term is a beginning."""
    if not phrases:
        return []
    parts = []
    for terms in phrases:
        for i, term in enumerate(terms):
            hit = F.col("term").startswith(term) if prefix and i == len(terms) - 1 else F.col("term") == term
            parts.append((hit, F.struct(F.lit(" ".join(terms)).alias("word"), F.lit(len(terms)).alias("of"), F.lit(i).alias("i"))))
    rows = index.postings.where(reduce(lambda a, b: a | b, [hit for hit, _ in parts]))
    named = rows.select("chunk_id", "text_at", "aux_at", F.explode(F.array_compact(F.array(*[F.when(hit, part) for hit, part in parts]))).alias("p"))

    def begun(column: str, text: int) -> Column:
        return F.transform(column, lambda x: F.struct((x - F.col("p.i")).alias("start"), F.lit(text).alias("text")))

    starts = named.select("chunk_id", "p.word", "p.of", F.col("p.i").alias("i"), F.explode(F.concat(begun("text_at", 1), begun("aux_at", 0))).alias("s")).select("chunk_id", "word", "of", "i", "s.*")
    whole = starts.groupBy("word", "chunk_id", "text", "start", "of").agg(F.countDistinct("i").alias("met")).where("met = of")
    text, aux = F.count_if(F.col("text") == 1), F.count_if(F.col("text") == 0)
    return [whole.groupBy("word", "chunk_id").agg(_weight(text, aux, aux_weight).alias("tf"))]


def _matches(index: Index, phrases: list[tuple[str, ...]], prefix: bool, aux_weight: float = AUX_WEIGHT) -> DataFrame:
    """word, chunk_id, tf of all phrases of a query (words of one term are phrases of one). Only the postings of the query's
    terms are read; places are read only where there is a longer phrase."""
    single, longer = [p[0] for p in phrases if len(p) == 1], [p for p in phrases if len(p) > 1]
    found = reduce(DataFrame.unionByName, _one_term(index, single, prefix, aux_weight) + _phrase(index, longer, prefix, aux_weight))
    return found.groupBy("word", "chunk_id").agg(F.sum("tf").alias("tf"))


def _bm25(tf: Column, df: Column) -> Column:
    """What one word adds, of columns n, mean_length and length besides."""
    idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))


def _scores(index: Index, matches: DataFrame, by: list[str]) -> DataFrame:
    """BM25 (lower is better) and the number of matched words of each chunk, for each value of `by`. Document frequencies and
    the totals of the index are a row for each word of the query, which is joined by broadcast."""
    df = matches.groupBy(*by, "word").agg(F.count("*").alias("df"))
    totals = index.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    stats = F.broadcast(df.join(F.broadcast(totals), F.lit(True)))
    part = _bm25(F.col("tf"), F.col("df"))
    scored = matches.join(stats, [*by, "word"]).join(index.lengths.select("chunk_id", "length"), "chunk_id")
    return scored.groupBy(*by, "chunk_id").agg((-F.sum(part)).alias("score"), F.count("*").alias("matched"))


def rank_chunks(index: Index | Texts, query: str, mode: str = "and", aux_weight: float = AUX_WEIGHT) -> DataFrame:
    """chunk_id, score (lower is better) of the chunks that match all words of the query (and), any (or), or any word
    that begins with one of them (prefix: each prefix is one term). A word with underscores is a phrase."""
    phrases = index.phrases(query)
    if isinstance(index, Texts):
        if not phrases:
            return index.lower.select("chunk_id", *index.kept, F.lit(0.0).alias("score")).limit(0)
        m = int(mode == "prefix")
        found = index.scores(phrases, (bool(m),), aux_weight)
        return (found.where(F.col(f"matched{m}") == len(phrases)) if mode == "and" else found).select("chunk_id", *index.kept, F.col(f"score{m}").alias("score"))
    if not phrases:
        return index.lengths.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    scored = _scores(index, _matches(index, phrases, mode == "prefix", aux_weight), [])
    return (scored.where(F.col("matched") == len(phrases)) if mode == "and" else scored).select("chunk_id", "score")


def rank_tiers(index: Index | Texts, query: str) -> DataFrame:
    """chunk_id, tier, score for all tiers at once: 0 if a chunk has all words, 1 if any, 2 if only words that begin with one.

    Whole words and beginnings are two counts over the postings of one query, not searches one after the other."""
    phrases = index.phrases(query)
    if isinstance(index, Texts):
        if not phrases:
            return index.lower.select("chunk_id", *index.kept, F.lit(0).alias("tier"), F.lit(0.0).alias("score")).limit(0)
        tier = F.when(F.col("matched0") == len(phrases), 0).when(F.col("matched0") > 0, 1).otherwise(2)
        found = index.scores(phrases, (False, True)).withColumn("tier", tier)
        return found.select("chunk_id", *index.kept, "tier", F.when(F.col("tier") < 2, F.col("score0")).otherwise(F.col("score1")).alias("score"))
    if not phrases:
        return index.lengths.select("chunk_id", F.lit(0).alias("tier"), F.lit(0.0).alias("score")).limit(0)
    exact, begun = (_matches(index, phrases, prefix).withColumn("begun", F.lit(prefix)) for prefix in (False, True))
    scored = _scores(index, exact.unionByName(begun), ["begun"])
    tier = F.when(F.col("begun"), 2).when(F.col("matched") == len(phrases), 0).otherwise(1)
    best = scored.withColumn("tier", tier).groupBy("chunk_id").agg(F.min_by(F.struct("tier", "score"), "tier").alias("b"))
    return best.select("chunk_id", "b.tier", "b.score")


def _is_bulk() -> Column:
    return F.coalesce(F.get_json_object("detail", "$.assetClass").isin(*BULK_CLASSES), F.lit(False))


def demote(hits: DataFrame) -> DataFrame:
    """Scores times the factors of entity kind, chunk kind and asset class (scores are negative)."""
    factor = F.when(F.col("is_bulk") if "is_bulk" in hits.columns else _is_bulk(), DEMOTED_CLASS).otherwise(1.0)
    for column, factors in (("kind", DEMOTED_KIND), ("chunk_kind", DEMOTED_CHUNK)):
        for value, times in factors.items():
            factor = factor * F.when(F.col(column) == value, times).otherwise(1.0)
    return hits.withColumn("score", F.col("score") * factor)


def best_chunks(hits: DataFrame, *first: str) -> DataFrame:
    """The best chunk of each entity, by the columns `first`, its score and its id."""
    best = Window.partitionBy("id").orderBy(*first, "score", "chunk_id")
    return hits.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def _filtered(entities: DataFrame, kind: str, path_prefix: str) -> DataFrame:
    if kind:
        entities = entities.where(F.col("kind") == kind)
    if path_prefix:
        low = path_prefix.lower()
        entities = entities.where(F.lower("id").startswith("asset:" + low) | F.lower("path").startswith(low))
    return entities


def rerank(hits: DataFrame, query: str) -> DataFrame:
    """Scores raised by the share of the query's words (3 letters and more) in the name, and by inbound references."""
    words = [w for w in dict.fromkeys(query.lower().replace("_", " ").split()) if len(w) >= 3]
    name = F.lower(F.concat(F.col("name"), F.lit(" "), split_camel(F.translate(F.col("name"), "_", " "))))
    share = reduce(lambda a, w: a + F.contains(name, F.lit(w)).cast("int"), words, F.lit(0)) / max(1, len(words))
    return hits.withColumn("score", F.col("score") * (1 + 0.8 * share) * (1 + 0.12 * F.log2(1.0 + F.col("inbound"))))


def _owned(ranked: DataFrame, entities: DataFrame, chunks: DataFrame, kind: str = "", path_prefix: str = "") -> DataFrame:
    """Ranked chunks with their kind and entity, demoted. The filters are of entities, so they come before the join; what
    follows is by entity as well and finds the rows where the join left them."""
    told = ranked if "entity_id" in ranked.columns else ranked.join(chunks.select(F.col("id").alias("chunk_id"), "entity_id", F.col("kind").alias("chunk_kind")), "chunk_id")
    owners = _filtered(entities, kind, path_prefix).select(F.col("id").alias("entity_id"), "kind", "name", _is_bulk().alias("is_bulk"))
    return demote(told.join(owners, "entity_id")).withColumnRenamed("entity_id", "id").drop("is_bulk")


#: Matching chunks that a page of entities is looked for among, before more are joined with their entities; and in pages, at least.
LIKELY, _LIKELY_PAGES = 2000, 10
#: Matching chunks that entities are looked up by in a broadcast, instead of being dealt out with them.
MOST_BROADCAST = 100_000


def _of_ids(entities: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The entities of some hits, LIKELY ids at most are a filter of the scans that entities are made of: of all other rows
    only the id is made."""
    ids = [r[0] for r in hits.select(key).distinct().limit(LIKELY + 1).collect()]
    return entities.where(F.col("id").isin(ids)) if len(ids) <= LIKELY else entities


def _classes() -> list[tuple[str, bool]]:
    """The kinds of entities ("": any that isn't demoted) and whether they are bulk, by how much of a score they leave."""
    left = lambda c: DEMOTED_KIND.get(c[0], 1.0) * (DEMOTED_CLASS if c[1] else 1.0)
    return sorted(((kind, bulk) for kind in ("", *DEMOTED_KIND) for bulk in (False, True)), key=left, reverse=True)


def best_page(ranked: DataFrame, entities: DataFrame, chunks: DataFrame, most: int, first: tuple[str, ...] = (), digits: int | None = None, **filters: str) -> DataFrame:
    """The best `most` entities by the columns `first`, the score (rounded to some digits) and the id, each with its best chunk
    and without its name.

    No entity raises a score, so what a chunk can reach is known before its entity is. The entities of the chunks that can
    reach most are looked up; where another chunk could still come before the page's last, others are joined: with entities
    that lower no score first, and with those that do only where the lowered score still could."""
    if "entity_id" not in ranked.columns:
        return best_chunks(_owned(ranked, entities, chunks, **filters), *first).drop("name").orderBy(*first, "score", "id").limit(most)
    told = ranked.where(F.col("entity_id").isNotNull())
    shown = lambda c: F.col(c) if digits is None else F.round(c, digits)
    raw, key = told.columns, [*first, "_shown", "entity_id"]

    def reach(kind: str, bulk: bool) -> DataFrame:
        """The chunks, and the score that is shown of them with an entity of a class."""
        lowered = demote(told.withColumns({"raw": F.col("score"), "kind": F.lit(kind), "is_bulk": F.lit(bulk)})).select(*raw, "raw", shown("score").alias("_shown"))
        return lowered.withColumn("score", F.col("raw")).drop("raw")

    def page(hits: DataFrame, owners: DataFrame, before: DataFrame | None = None) -> DataFrame:
        best = _owned(hits, owners, chunks, **filters).drop("name").withColumn("_shown", shown("score"))
        return cut(best_chunks(best if before is None else best.unionByName(before), *first).orderBy(*first, "_shown", "id").limit(most))

    def last(hits: DataFrame, columns: list[str]) -> tuple:
        return tuple(hits.orderBy(*[F.desc(c) for c in columns]).select(*columns).first())

    few = max(LIKELY, _LIKELY_PAGES * most)
    likely = cut(reach("", False).orderBy(*key).limit(few))
    found = page(F.broadcast(likely.select(*raw)), _of_ids(entities, likely, "entity_id"))
    if likely.count() < few:
        return found.drop("_shown")
    if found.count() < most:
        return page(told, entities).drop("_shown")
    if last(found, [*first, "_shown", "id"]) < last(likely, key):
        return found.drop("_shown")
    for kind, bulk in _classes():
        worst = last(found, [*first, "_shown", "id"])
        hits = reach(kind, bulk)
        hits = hits.where(F.struct(*key) <= F.struct(*[F.lit(x).cast(hits.schema[c].dataType).alias(c) for c, x in zip(key, worst)])).select(*raw)
        n = hits.count()
        if not n:
            break  # nor could any with entities that leave less of a score
        own = F.coalesce("kind", F.lit(""))
        owners = entities.where((own == kind if kind else ~own.isin(*DEMOTED_KIND)) & (_is_bulk() == bulk))
        if n <= LIKELY:
            owners = _of_ids(owners, hits, "entity_id")
        found = page(F.broadcast(hits) if n <= MOST_BROADCAST else hits, owners, found)
    return found.drop("_shown")


def hits_of(index: Index | Texts, entities: DataFrame, chunks: DataFrame, query: str, mode: str, kind: str = "", path_prefix: str = "") -> DataFrame:
    """The best chunk of each entity that matches, demoted and filtered."""
    return best_chunks(_owned(rank_chunks(index, query, mode), entities, chunks, kind, path_prefix))


def with_inbound(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits with the number of edges that point to them."""
    inbound = links_at(edges, "dst", hits).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
    return hits.join(inbound, "id", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))


def search(index: Index | Texts, entities: DataFrame, edges: DataFrame, chunks: DataFrame, query: str, kind: str = "", limit: int = 20, offset: int = 0, path_prefix: str = "") -> DataFrame:
    """id, kind, name, score, chunk_id, chunk_kind, inbound of a page of hits, best first.

    All words, any word, any beginning of a word: the first of these that finds anything answers, whatever the page; the best OVERFETCH * (offset + limit) hits of it,
    MOST_FETCHED at most unless the page itself is longer, are re-ranked. All three are found in one pass over the
    query's postings: in the order of tiers, the first hits are those of the first that has any."""
    limit, offset = limit if limit > 0 else 20, max(0, offset)
    fetch = max(min((offset + limit) * OVERFETCH, MOST_FETCHED), offset + limit)
    kept = cut(best_page(rank_tiers(index, query), entities, chunks, fetch, ("tier",), kind=kind, path_prefix=path_prefix))  # names are looked up for these alone
    top = kept.join(F.broadcast(kept.agg(F.min("tier").alias("tier"))), "tier", "left_semi").drop("tier")
    top = with_inbound(_of_ids(entities, kept, "id").select("id", "name").join(F.broadcast(top), "id"), edges)
    return rerank(top, query).withColumn("score", F.round("score", 6)).orderBy("score", "id").offset(offset).limit(limit).select("id", "kind", "name", "score", "chunk_id", "chunk_kind", "inbound")


def snippets(hits: DataFrame, chunks: DataFrame, query: str, words: int = 12) -> DataFrame:
    """hits (chunk_id) with snippet: `words` words of the text around its first match, matches in brackets."""
    terms = F.array(*[F.lit(t) for t in query_terms(query)]) if query_terms(query) else F.array().cast("array<string>")
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    marked: Column = F.transform("w", lambda w: F.when(F.arrays_overlap(index_terms(w), terms), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    first = F.greatest(F.array_position(F.transform("m", lambda w: F.startswith(w, F.lit("[")).cast("int")), 1), F.lit(1))
    out = hits.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id").withColumn("w", tokens).withColumn("m", marked)
    out = out.withColumn("from", F.greatest(first - words // 3, F.lit(1)).cast("int"))
    body = F.array_join(F.slice("m", F.col("from"), F.lit(words)), " ")
    return out.withColumn("snippet", F.concat(F.when(F.col("from") > 1, "... ").otherwise(""), body, F.when(F.size("m") > F.col("from") + words - 1, " ...").otherwise(""))).drop("text", "w", "m", "from")


def diverse_seeds(hits: DataFrame, seeds: int) -> DataFrame:
    """The best `seeds` hits of which no kind has more than max(2, seeds / 3) before others had their turn."""
    quota = max(2, seeds // 3)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("score", "id"))
    return hits.withColumn("over", (place > quota).cast("int")).orderBy("over", "score", "id").limit(seeds).select("id", "kind", "name", "score", "over")


def explain(index: Index | Texts, entities: DataFrame, edges: DataFrame, chunks: DataFrame, topic: str, limit: int = 8, neighbours: int = 200) -> DataFrame:
    """Seeds of a topic and their direct neighbours: role (seed, neighbour), id, kind, name, seed."""
    seeds = cut(diverse_seeds(search(index, entities, edges, chunks, topic, limit=3 * limit), limit).select("id", "kind", "name"))  # `limit` rows
    near = [links_at(edges, own, seeds).select(F.col(own).alias("seed"), F.col(other).alias("id")) for own, other in (("src", "dst"), ("dst", "src"))]
    around = near[0].unionByName(near[1]).distinct()
    around = around.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).where(F.col("place") <= neighbours)
    fresh = around.groupBy("id").agg(F.min("seed").alias("seed")).join(F.broadcast(seeds.select("id")), "id", "left_anti")  # limit * neighbours at most
    fresh = entities.select("id", "kind", "name").join(F.broadcast(fresh), "id")
    return seeds.select(F.lit("seed").alias("role"), "id", "kind", "name", F.col("id").alias("seed")).unionByName(fresh.select(F.lit("neighbour").alias("role"), "id", "kind", "name", "seed"))
