"""Token counts of the sections of a text: whole texts are encoded once and tokens are joined to sections by place."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks

RULES = ("start", "end", "most")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    """The encoding of a file of ranks, and the UTF-8 length of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(raw: bytes) -> np.ndarray:
    """First bytes of the lines of a text; a line has its own line feed, so the lines cover the text."""
    cuts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], cuts[cuts < len(raw)]])


def allocate(token_ends: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token, given the tokens' end bytes and the sections' first bytes (both ascending).

    A token that crosses a boundary goes to the section of its first byte (start), of its last byte (end), or to the
    one that holds most of its bytes, ties to the earlier one (most)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    token_starts = np.concatenate([[0], token_ends])[: len(token_ends)].astype(np.int64)
    first = np.searchsorted(starts, token_starts, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(starts, token_ends - 1, "right") - 1
    if rule == "end":
        return last
    out, edges = first.copy(), np.append(starts, token_ends[-1] if len(token_ends) else 0)
    for i in np.flatnonzero(first != last):
        own = np.arange(first[i], last[i] + 1)
        out[i] = own[np.argmax(np.minimum(edges[own + 1], token_ends[i]) - np.maximum(edges[own], token_starts[i]))]
    return out


def attribute_tokens(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", fields_col: str | None = None) -> DataFrame:
    """One row for each document and section: doc_id, section int (from 0), start_char and end_char (code points, end
    exclusive), n_chars, n_tokens, n_crossing (tokens of the section that other sections share).

    Sections are the lines of the text, each with its line feed, so that the counts of a document's sections add up to
    those of the whole text. With fields_col (array<string>), the text is the fields joined with nothing between and
    the sections are the fields; null fields are empty. Each text is encoded once, whole, as ordinary text; tokens
    carry byte places, which are searched in the sections' places (an interval join without pairs) and allocated by
    `rule` (see allocate). A null or empty text has one section with no tokens, so that each document is present;
    repeated rows give repeated rows; other columns are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(path, pattern)
        for whole in batches:
            for batch in text_chunks(whole, "text"):
                rows = []
                fields = batch.column("fields").to_pylist() if fields_col else None
                for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                    raw = (text or "").encode()
                    if fields_col:
                        sizes = [len((x or "").encode()) for x in fields[i] or [""]]
                        starts = np.cumsum([0, *sizes[:-1]])
                    else:
                        starts = line_starts(raw)
                    ids = np.asarray(encoding.encode_to_numpy(text, disallowed_special=())) if raw else np.zeros(0, np.int64)
                    ends = np.cumsum(lengths[ids])
                    n = len(starts)
                    if fields_col:  # empty sections own no byte: search among the others
                        own = np.flatnonzero(np.array(sizes) > 0)
                        at = own[allocate(ends, starts[own], rule)] if len(own) else np.zeros(0, np.int64)
                        first = own[allocate(ends, starts[own], "start")] if len(own) else at
                        last = own[allocate(ends, starts[own], "end")] if len(own) else at
                    else:
                        at, first, last = allocate(ends, starts, rule), allocate(ends, starts, "start"), allocate(ends, starts, "end")
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    edges = points[np.append(starts, len(raw))]
                    rows.append((np.full(n, doc if doc is not None else 0), np.full(n, doc is None), np.arange(n), edges[:-1], edges[1:], np.bincount(at, minlength=n), np.bincount(at[first != last], minlength=n)))
                docs, null, section, start, end, tokens, crossing = map(np.concatenate, zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(docs.astype(np.int64), mask=null), pa.array(section.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (start, end, end - start, tokens, crossing))], names=["doc_id", "section", "start_char", "end_char", "n_chars", "n_tokens", "n_crossing"])

    text = F.concat_ws("", F.col(fields_col)) if fields_col else F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([F.col(fields_col).cast("array<string>").alias("fields")] if fields_col else []))
    return map_arrow(docs, count, "doc_id long, section int, start_char long, end_char long, n_chars long, n_tokens long, n_crossing long")
