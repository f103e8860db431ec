"""Spelling variant grouping: words one edit apart, found by generating every neighbour of every word.

A word's neighbours are all strings that one deletion, replacement or insertion over the observed alphabet makes of it (the alphabet is that of the words it can meet).
A neighbour that is itself a word is near by construction, so a hash join with the vocabulary finds all near words and
nothing is compared. The join is laid out so that neighbours never travel: an edit leaves one half of a word as it is, so a
word and its neighbour share that half, and both are dealt to one group by it. Each neighbour is generated in one group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shuffle_partitions

# What a word is made of, how long and how often it is, which runs lose a letter, when a near word is the form.
RUN, LEAST_LENGTH, LEAST_COUNT, EVERY, TIMES = "[A-Za-zÀ-ÿ]", 7, 2, 31, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer words have their one-letter deletions hashed instead: their neighbours together are as long as a square of them.
LONGEST = 64
_FOUND = "word string, n_near long, low long, form string"


def lower_ascii(text: Column) -> Column:
    """Only A-Z in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of all texts that are long enough, lower-cased, with a letter taken out where the rule
    says so, and their occurrences. Counting begins in each task, so frequent words are no hot keys."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), F.lit(1))
    id = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    runs = df.select(id.alias("id"), F.explode(found).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def neighbours(word: str, letters: str, longer: bool, start: int, stop: int) -> list[str]:
    """Distinct neighbours whose edit lies at one of the places start to stop of the longer of the two: `longer` makes those of
    one more letter, else there are replacements and deletions. Among equal letters the edit is at the first."""
    out: list[str] = []
    for i in range(start, stop):
        head, rest = word[:i], word[i:]
        last = word[i - 1] if i else ""
        if longer:
            out += [head + c + rest for c in letters if c != last]
        else:
            own, rest = rest[0], rest[1:]
            out += [head + c + rest for c in letters if c != own]
            if own != last:
                out.append(head + rest)
    return out


def _near_in_groups():
    """For rows (key, long, head, word, n) in order of key: what each word of a group finds there."""

    def close(group: dict[str, int], asks: list[tuple[str, int, bool]]) -> Iterator[tuple[str, int, int, str]]:
        if len(group) < 2:  # no other word shares the half, so none of these neighbours is a word
            return
        words, letters = set(group), "".join(set("".join(group)))  # a word of the group has no other letters
        for word, long, head in asks:
            cut = long // 2
            span = (cut, long) if head else (0, cut)
            near = words.intersection(neighbours(word, letters, len(word) < long, *span))
            if near:
                low, form = min((-group[other], other) for other in near)
                yield word, len(near), low, form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[str, int] = {}
        asks: list[tuple[str, int, bool]] = []
        last, names = None, ["word", "n_near", "low", "form"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=names)
        for batch in batches:
            found = []
            for key, long, head, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "long", "head", "word", "n"))):
                if key != last:
                    found += close(group, asks)
                    group, asks, last = {}, [], key
                group[word] = n
                asks.append((word, long, head))
            if found:
                yield pack(found)
        found = list(close(group, asks))
        if found:
            yield pack(found)

    return run


def _near_short(words: DataFrame) -> DataFrame:
    """What words of LONGEST letters at most find. The longer word of a pair has `long` letters: a word is in the groups of
    its own length (for replacements and deletions) and of one more (for insertions), by first and by last half."""
    length, half = F.length("word"), F.floor(F.col("long") / 2).cast("int")
    placed = words.withColumn("long", F.explode(F.array(length, length + 1))).withColumn("head", F.explode(F.array(F.lit(True), F.lit(False))))
    placed = placed.where(F.col("long") <= LONGEST + 1)
    shared = F.when(F.col("head"), F.left("word", half)).otherwise(F.right("word", F.col("long") - half))
    keyed = placed.select(F.xxhash64("long", "head", shared).alias("key"), "long", "head", "word", "n")
    dealt = keyed.repartition(shuffle_partitions(words.sparkSession), "key").sortWithinPartitions("key")
    return map_arrow(dealt, _near_in_groups(), _FOUND).where(F.length("word") <= LONGEST)


def deletion_hashes(word: str) -> np.ndarray:
    """A polynomial hash, modulo 2^64, of the word without each of its letters, in a time proportional to its length."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:n], dtype=np.uint64)])
        return upto[:n] * power[1] + (upto[n] - upto[1:])  # the letters before the place move one power up


def _near_long(words: DataFrame) -> DataFrame:
    """Near words of those with more than LONGEST letters: a replacement leaves the same word without the letter at one
    place, and a deletion leaves the other word. Such a key has no more words than there are letters, and a word has as
    many keys as letters. Hashes only propose; what they propose is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                whole = deletion_hashes(word + "a")[-1:]  # the word itself, in the same scale
                hashes, n = np.append(deletion_hashes(word), whole).view(np.int64), len(word)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, id)), pa.array(np.append(np.arange(n), -1).astype(np.int32)), pa.array(hashes)], names=["id", "place", "h"])

    some = words.where(F.length("word") >= LONGEST)
    ids = materialize(some.select(F.xxhash64("word").alias("id"), "word", "n"), "long-words")
    keys = materialize(map_arrow(ids.select("id", "word"), run, "id long, place int, h long"), "long-keys")
    a, b = keys.alias("a"), keys.alias("b")
    replaced = a.join(b, ["place", "h"]).where("place >= 0 and a.id <> b.id").select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    shorter = a.where("place = -1").join(b.where("place >= 0"), "h").select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    pairs = replaced.unionByName(shorter).unionByName(shorter.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    named = pairs.join(ids.select(F.col("id").alias("x"), "word"), "x").join(ids.select(F.col("id").alias("y"), F.col("word").alias("form"), "n"), "y")
    real = named.where((F.length("word") > LONGEST) & (F.levenshtein("word", "form", 1) == 1))
    return real.select("word", "form", "n").distinct().select("word", F.lit(1).cast("long").alias("n_near"), (-F.col("n")).alias("low"), "form")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near (its near words among words), near (the most frequent of them; ties: the first in code-point order) and
    near_n, of the words that have any. words: word, n, without repeated or null words."""
    found = _near_short(words)
    if not words.where(F.length("word") > LONGEST).isEmpty():
        found = found.unionByName(_near_long(words))
    best = F.min(F.struct("low", "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("near"), (-F.col("b.low")).alias("near_n"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """word, root for words with a form (word, form): forms followed to the last. A form is TIMES as frequent as its word, so
    chains end, and doubling the steps takes few rounds."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(at.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return at


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the texts.

    The form is the most frequent near word, if it occurs `times` as often as the word; the root is what forms lead to.
    Null and empty texts have no words; a null id counts as empty in the rule that takes letters out; repeated ids and
    rows add up; other columns are ignored; an empty table gives no rows. Words of any length are compared exactly."""
    words = materialize(vocabulary(df, id_col, text_col), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    told = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    told = materialize(told, "forms")
    roots = follow_forms(told.where("form is not null"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
