"""Fill-in-middle transformation: texts are cut into prefix, middle and suffix between tokens and put in another order.

A token is white space with the word after it; white space at the end of a text is one token. All cuts of a batch are
found together: a byte-class table marks white space, comparing neighbouring bytes marks token ends, a running sum that
starts anew at each document counts them, and one searchsorted turns the drawn unit numbers of all rows into bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The letter within a marker; a marker is three bytes.
_LETTER = np.zeros(256, bool)
_LETTER[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True
_FORMS = np.array(["plain", "psm", "spm"])
_FIELDS = "fim_n long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of 8 digits of the hex sha256 of `<seed>:<doc_id>`; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"fim_h{i + 1}") for i in range(4)]


def _buffers(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The array with 64-bit offsets from 0, its bytes and its offsets."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return texts, data, offsets - offsets[0]


def _rows_with_marker(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text contains one of the three markers."""
    found = np.zeros(len(offsets) - 1, bool)
    if len(data) >= 3:
        at = np.flatnonzero((data[:-2] == ord("<")) & _LETTER[data[1:-1]] & (data[2:] == ord(">")))
        row = np.searchsorted(offsets, at, "right") - 1
        found[row[at + 3 <= offsets[row + 1]]] = True
    return found


def transform_batch(texts: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all texts of a batch."""
    _, data, offsets = _buffers(texts)
    starts, ends = offsets[:-1], offsets[1:]
    filled = ends > starts
    space = _SPACE[data]
    stop = np.zeros(len(data), bool)
    stop[:-1] = ~space[:-1] & space[1:]
    stop[ends[filled] - 1] = True  # the end of a document ends its last token ...
    inner = ends[filled][:-1] - 1  # ... and no token goes on in the next document, whatever its first byte
    stop[inner] = True
    upto = np.cumsum(stop, dtype=np.int64)
    before = np.where(starts > 0, upto[np.maximum(starts - 1, 0)], 0) if len(data) else np.zeros(len(starts), np.int64)
    n = np.where(filled, upto[np.maximum(ends - 1, 0)] - before, 0) if len(data) else np.zeros(len(starts), np.int64)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    units = np.stack([np.minimum(one, two), np.maximum(one, two)])
    cuts = np.where(units > 0, np.searchsorted(upto, before + units) + 1, starts)
    plain = ~filled | _rows_with_marker(data, offsets) | (h[2] % 100 >= fim_percent)
    spm = ~plain & (h[3] % 100 < spm_percent)

    # The parts of all texts lie one after another in the buffer, so they are one array over it.
    edges = np.append(np.stack([starts, cuts[0], cuts[1]], axis=1).reshape(-1), offsets[-1])
    parts = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))
    prefix, middle, suffix = (parts.take(pa.array(np.arange(i, 3 * len(n), 3))) for i in range(3))
    mark = lambda m: pa.scalar(m, pa.large_string())
    joined = lambda *p: pc.binary_join_element_wise(*p, mark(""))
    psm = joined(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    out = pc.if_else(pa.array(spm), joined(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle), psm)
    out = pc.if_else(pa.array(plain), joined(prefix, middle, suffix), out)
    form = pa.array(_FORMS[np.where(plain, 0, np.where(spm, 2, 1))].tolist(), pa.string())
    chars = [pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return [pa.array(n), form, *chars, out.cast(pa.string())]


def fill_in_middle(df: DataFrame, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's id with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null where plain) and output.

    The draws depend on seed and id alone, so a row's result doesn't depend on other rows, partitions or retries.
    Texts that are empty, null or contain a marker stay plain (null gives an empty output). Repeated ids get the same draws,
    each for its own text; null ids draw as an empty id. Other columns are ignored, whatever their names; an empty table
    gives no rows. Memory: some ten times the bytes of a step of CHUNK_BYTES, or of the longest text."""
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole):
                h = [batch.column(f"fim_h{i}").to_numpy() for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *transform_batch(texts_of(batch), h, fim_percent, spm_percent)], names=["doc_id", *(f.split()[0] for f in _FIELDS.split(", "))])

    done = map_arrow(keyed.select("doc_id", "text", *draws(F.col("doc_id"), seed)), run, f"doc_id long, {_FIELDS}")
    return done.select("doc_id", *[F.col(f.split()[0]).alias(f.split()[0].removeprefix("fim_")) for f in _FIELDS.split(", ")])


def restore(output: Column, form: Column) -> Column:
    """The text of an output. A transformed text holds no marker of its own, and none can arise where parts meet, so the
    markers part the output; psm has prefix, suffix, middle behind them, spm suffix, prefix, middle."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(transformed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
