"""Toxicity by compression distance: one zstandard dictionary is trained on toxic and one on ordinary text, and the
compressed lengths of each window of a text under them are compared.

So that one match is worth a whole word, texts are trained on and compressed as 8-byte codes of their words, numbers and
signs (lower case, each of them whole; in scripts without spaces, each character). A window's gain is its length under the ordinary dictionary less its length when
the toxic dictionary stands before the ordinary one: what toxic text explains of the window and ordinary text doesn't."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_chunks, texts_of

#: Labelled documents of either class that the dictionaries learn from at most (smallest id hashes), whole texts.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 3000, 6000
WINDOW = 24
#: Bytes of a dictionary at most, and bytes of training text for each of them.
TOXIC_BYTES, TOXIC_PER_BYTE, ORDINARY_BYTES, ORDINARY_PER_BYTE = 16 << 10, 16, 128 << 10, 8
#: (k, d) of the trainings whose contents make the ordinary dictionary: the trainer counts in a hash table, where each
#: training loses other codes to collisions.
PASSES = ((16, 8), (8, 6), (8, 8))
#: The trainer cuts the content that it chose first to make room for its header; so many first choices are filler.
FILLER = 64
THRESHOLD, HELD_OUT = 0.3, 2
#: Bins of one unit of the logistic's argument, in which the F1 score is looked at.
BINS = 256
# The blocks of Unicode whose scripts put no spaces between words (Thai and Lao, Burmese, Khmer, Kana, Han).
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
#: Characters of those scripts, words, numbers, runs of ASCII signs, and other signs one by one: all but white space.
WORD = rf"[{UNSPACED}]|(?:(?![{UNSPACED}])[^\W\d_])+|\d+|[!-/:-@\[-`{{-~]+|[^\w\s]"


class Coder:
    def __init__(self, limit: int = 100_000):
        self.memo: dict[str, bytes] = {}
        self.limit, self.find = limit, re.compile(WORD).findall

    def codes(self, text: str) -> list[bytes]:
        out, memo = [], self.memo
        for word in self.find(text.lower()):
            code = memo.get(word)
            if code is None:
                code = xxhash.xxh64_digest(word)
                if len(memo) < self.limit and len(word) <= 48:
                    memo[word] = code
            out.append(code)
        return out

    def distinct(self, text: str) -> bytes:
        """The text's different codes, in an order of its own, so that no two codes stand together in many texts."""
        codes = set(self.codes(text))
        return b"".join(sorted(codes, key=lambda code: xxhash.xxh64_intdigest(code, len(codes))))


def train(samples: list[bytes], most: int, per_byte: int, passes: tuple[tuple[int, int], ...]) -> bytes:
    """The dictionaries that the library trains on the samples with each (k, d), joined;
    of samples that are too few for the library, all of their different codes."""
    total = sum(map(len, samples))
    size = max(512, min(most, total // per_byte))
    filler = np.random.default_rng(5).bytes(8 * max(FILLER, total * FILLER * 4 // size))
    try:
        return b"".join(zstandard.train_dictionary(size, [filler, *samples], k=k, d=d, f=24).as_bytes() for k, d in passes)
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(s[a : a + 8] for s in samples for a in range(0, len(s), 8))) or bytes(8)


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float]):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        # Matches of 6 bytes and more are of whole codes, and a code is the only one of its hash (greedy search hashes 6 at most).
        rules = zstandard.ZstdCompressionParameters(window_log=20, hash_log=20, chain_log=20, search_log=3, min_match=6, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False)
        self.coder, self.sides = Coder(), []
        for content in (model.ordinary, model.toxic + model.ordinary):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=rules)
            self.sides.append(zstandard.ZstdCompressor(compression_params=rules, dict_data=data).compress)

    def gains(self, text: str) -> list[int]:
        """Of each window: bytes that the toxic dictionary saves beside the ordinary one."""
        coded, step = b"".join(self.coder.codes(text)), WINDOW * 8
        ordinary, both = self.sides
        return [len(ordinary(w)) - len(both(w)) for w in (coded[a : a + step] for a in range(0, len(coded), step))]

    def features(self, text: str) -> list[float]:
        gains = self.gains(text)
        n = len(gains)
        positive = sum(g for g in gains if g > 0)
        return [1.0, positive / n**0.5 / 4, sum(gains) / n, max(gains) / 8, float(np.log1p(n))] if n else [1.0, 0.0, 0.0, 0.0, 0.0]


def _argument(weights: np.ndarray) -> Column:
    return sum((float(w) * F.col(f"f{i}") for i, w in enumerate(weights[1:], 1)), F.lit(float(weights[0])))


def _logistic(rows: DataFrame, total: float, pull: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Newton's method over rows (toxic, weight, f1 to f4) where they lie; the driver sees the sums of a round."""
    w = np.zeros(5)
    x = [F.lit(1.0), *(F.col(f"f{i}") for i in range(1, 5))]
    above = [(i, j) for i in range(5) for j in range(i, 5)]
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.least(_argument(w), F.lit(30.0)), F.lit(-30.0))))
        each = rows.withColumn("_p", p).withColumn("_g", F.col("weight") * (F.col("_p") - F.col("toxic"))).withColumn("_h", F.col("weight") * F.col("_p") * (1 - F.col("_p")))
        sums = each.agg(*[F.sum(F.col("_h") * x[i] * x[j]) for i, j in above], *[F.sum(F.col("_g") * v) for v in x]).first()
        h = pull * np.eye(5)
        for (i, j), v in zip(above, sums):
            h[i, j] += v / total
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, np.array(sums[len(above) :]) / total + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_cut(rows: DataFrame, weights: np.ndarray) -> float:
    """Where the F1 score of rows (toxic, weight, f1 to f4) is best, from a histogram of the logistic's argument."""
    z = F.greatest(F.least(_argument(weights), F.lit(60.0)), F.lit(-60.0))
    bins = rows.select("toxic", "weight", z.alias("z")).groupBy(F.floor(F.col("z") * BINS).alias("bin"))
    bins = bins.agg(F.sum("weight").alias("all"), F.sum(F.col("weight") * F.col("toxic")).alias("hits"), F.min("z").alias("low"), F.max("z").alias("high")).collect()
    bins.sort(key=lambda r: -r["bin"])
    hits, found = np.cumsum([r["hits"] for r in bins]), np.cumsum([r["all"] for r in bins])
    best = int(np.argmax(2 * hits / (found + hits[-1])))
    return (bins[best]["low"] + bins[min(best + 1, len(bins) - 1)]["high"]) / 2 if best + 1 < len(bins) else bins[best]["low"]


def dictionaries(samples: list[bytes], toxic: list[int]) -> Model:
    """The model without weights, from distinct codes of texts; equal samples count once."""
    sides = [list(dict.fromkeys(c for c, y in zip(samples, toxic) if y == label and len(c) >= 8)) for label in (0, 1)]
    ordinary = train(sides[0], ORDINARY_BYTES, ORDINARY_PER_BYTE, PASSES)
    return Model(train(sides[1], TOXIC_BYTES, TOXIC_PER_BYTE, ((8, 8),)), ordinary, [0.0] * 5)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Coder()
    for whole in batches:
        for batch in text_chunks(whole):
            codes = pa.array([coder.distinct(t) for t in texts_of(batch).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("doc_id"), batch.column("toxic"), codes], names=["h", "doc_id", "toxic", "codes"])


FEATURES = ("f1", "f2", "f3", "f4")


def dictionaries_of(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The dictionaries of docs (doc_id, text), without weights; the labels that aren't held out (doc_id, toxic), and the
    ids that the dictionaries learned from."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(_fold() != HELD_OUT).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    learn = known.where("pmod(h, 5) < 3")
    sample = materialize(learn.where("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE_TOXIC).unionByName(learn.where("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE_ORDINARY)), "toxicity-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    coded = map_arrow(texts.join(F.broadcast(sample), "doc_id").select("h", "doc_id", "toxic", "text"), _coded, "h long, doc_id long, toxic int, codes binary")
    rows = sorted((r["h"], r["doc_id"], bytes(r["codes"]), r["toxic"]) for r in coded.collect())
    return dictionaries([r[2] for r in rows], [r[3] for r in rows]), known.select("doc_id", "toxic"), sample.select("doc_id")


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def with_features(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, without columns named as features, with f1 to f4 of each row's whole text: one pass where the rows lie."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for whole in batches:
            for batch in text_chunks(whole, text_col):
                x = np.array([scorer.features(t) for t in texts_of(batch, text_col).to_pylist()]).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(1, 5))], names=[*batch.schema.names, *FEATURES])

    kinds = [*(f"`{n}` {k}" for n, k in docs.dtypes), *(f"{f} double" for f in FEATURES)]
    return map_arrow(docs, add, ", ".join(kinds))


def calibrate(model: Model, rows: DataFrame, known: DataFrame, learned: DataFrame) -> None:
    """Sets the model's weights from rows (doc_id, f1 to f4): a logistic over all labelled documents that the dictionaries
    didn't learn from, weighted so that each class has its share of all labelled ones, and moved so that THRESHOLD lies
    where the F1 score is best. Without both classes among them, scores are the share of toxic documents."""
    scored = rows.select("doc_id", *FEATURES).join(known, "doc_id").join(F.broadcast(learned.withColumn("learned", F.lit(True))), "doc_id", "left")
    scored = materialize(scored.select("toxic", F.coalesce("learned", F.lit(False)).alias("learned"), *FEATURES), "toxicity-labelled")
    counts = {r["toxic"]: (r["all"], r["others"]) for r in scored.groupBy("toxic").agg(F.count("*").alias("all"), F.sum(F.expr("if(learned, 0, 1)")).alias("others")).collect()}
    total = sum(n for n, _ in counts.values())
    if any(not counts.get(c, (0, 0))[1] for c in (0, 1)):
        share = float(np.clip(counts.get(1, (0, 0))[0] / total if total else 0.1, 1e-3, 1 - 1e-3))
        model.weights = [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0]
        return
    weight = F.when(F.col("toxic") == 1, counts[1][0] / counts[1][1]).otherwise(counts[0][0] / counts[0][1])
    others = scored.where("not learned").select(F.col("toxic").cast("double").alias("toxic"), weight.alias("weight"), *FEATURES)
    w = _logistic(others, total)
    w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(others, w)
    # Sums depend on the order of rows in their last digits.
    model.weights = [round(float(v), 9) for v in w]


def _score(model: Model) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(_argument(np.array(model.weights)), F.lit(30.0)), F.lit(-30.0))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled documents that aren't held out.

    The dictionaries learn from a bounded sample of three in five of them, by whole texts; the calibration comes from all
    others. Texts become distinct codes, or features, where they lie."""
    model, known, learned = dictionaries_of(docs, labels)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    calibrate(model, with_features(ids.where(_fold() != HELD_OUT), model).drop("text"), known, learned)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs (doc_id, text).

    held_out: crc32 of the id as text, mod 4, is 2; such rows' labels are never read. score (0 to 1) is a calibrated
    logistic of the windows' gains over the whole text; predicted is 1 from THRESHOLD on. All texts become features in
    one pass where they lie; the features are written, calibrate the model and are scored. Null and empty texts, and
    texts of white space alone, have the score of no evidence; repeated rows give repeated rows; an empty table gives none; a
    null id is not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        model, known, learned = dictionaries_of(docs, labels)
        rows = materialize(with_features(rows, model).drop("text"), "toxicity-features")
        calibrate(model, rows, known, learned)
    else:
        rows = with_features(rows, model).drop("text")
    held = F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, _score(model).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """docs without the rows that score_toxicity() would predict to be toxic; null and empty texts are scored as there,
    repeated rows are kept or dropped alike, other columns stay, and an empty table stays empty.

    The rows are written once with their features, from which the model is calibrated and rows are kept."""
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("own"), F.col("text").cast("string").alias("text"))
    if model is None:
        model, known, learned = dictionaries_of(docs, labels)
        own = materialize(with_features(own, model), "toxicity-rows")
        calibrate(model, own.select(F.col("own.doc_id").cast("long").alias("doc_id"), *FEATURES), known, learned)
    else:
        own = with_features(own, model)
    kept = own.where(_score(model) < THRESHOLD)
    return kept.select(*[F.col("text").cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])
