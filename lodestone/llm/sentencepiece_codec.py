"""SentencePiece encoding and decoding with byte spans in the original text."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, map_arrow, text_chunks, texts_of

#: Bytes of text that are encoded at a time: what a step makes of them (lists of ids, places of pieces) is many times larger.
STEP_BYTES = 256 << 10
SPACE = "▁"
_MARK = SPACE.encode()


class CharMap:
    """A model's compiled character map: a double-array trie of source strings, and their replacements.

    Layout (little endian): u32 size of the trie, its u32 units, then the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that source has at `at`."""
        if not self.units:
            return None
        jump = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        node, found = jump(self.units[0]), None
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Normalizer:
    """A model's normalisation rules. normalize() gives the normalised bytes and, for each of their places (the end
    included), the byte of the source that it comes from. What a rule replaced comes from the rule's first byte."""

    def __init__(self, spec, suffix: bool = False):
        self.map, self.escape = CharMap(spec.precompiled_charsmap), spec.escape_whitespaces
        self.dummy, self.squeeze, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        source = text.encode()
        if self.map or self.squeeze or self.suffix:
            return self._by_prefix(source)
        if not source:
            return b"", np.zeros(1, np.int64)
        # No entry can match, so each longest prefix is one character, which stays; only spaces are escaped.
        mark = _MARK if self.escape else b" "
        wide = np.where(np.frombuffer(source, np.uint8) == 32, len(mark), 1)
        align = np.repeat(np.arange(len(source)), wide)
        lead = mark if self.dummy else b""
        return lead + source.replace(b" ", mark), np.concatenate([np.zeros(len(lead), np.int64), align, [len(source)]])

    def _by_prefix(self, source: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at, mark = bytearray(), [], 0, _MARK if self.escape else b" "

        def step() -> tuple[bytes, int]:
            found = self.map.longest(source, at)
            if found:
                return found[1], found[0]
            lead = source[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return source[at : at + n], n

        def put(piece: bytes, start: int, exact: bool) -> None:
            out.extend(piece)
            align.extend(range(start, start + len(piece)) if exact else [start] * len(piece))

        if self.squeeze:
            while at < len(source):
                piece, n = step()
                if piece != b" ":
                    break
                at += n
        if at == len(source):
            return b"", np.array([len(source)])
        if self.dummy and not self.suffix:
            put(mark, at, False)
        after_space = self.squeeze
        while at < len(source):
            piece, n = step()
            if after_space:
                piece = piece.lstrip(b" ")
            exact = piece == source[at : at + n]
            for k, byte in enumerate(piece):
                put(mark if byte == 32 else bytes([byte]), at + k * exact, False)
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
            at += n
        end = at
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = align[-len(mark)]
                del align[-len(mark) :]
        if self.dummy and self.suffix:
            put(mark, end, False)
        return bytes(out), np.array([*align, end])


class Codec:
    """Encodes as the library does, with spans. Words are memoised only where the vocabulary shows that no merge can
    join a character to a following space mark; other texts are encoded whole."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds, pieces = model.ModelProto.SentencePiece, proto.pieces
        self.normalizer = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.lengths = np.array([1 if p.type == kinds.BYTE else 0 if p.type in (kinds.CONTROL, kinds.UNKNOWN) else len(p.piece.encode()) for p in pieces], np.int64)
        self.unknown = self.library.unk_id()
        n = self.normalizer
        self.by_word = bool(not n.map and not n.squeeze and not n.suffix and n.dummy and n.escape and not any(SPACE in p.piece.lstrip(SPACE) or p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in pieces) and proto.trainer_spec.model_type == 2)
        self.decimals = [str(i) for i in range(len(pieces))]
        self.memo = WordMemo(lambda words: self.library.encode(words, num_threads=1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids."""
        if not self.by_word:
            return self._joined(self.library.encode(texts.to_pylist(), num_threads=1))
        odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}")
        ids, offsets = self.memo.encode(pc.split_pattern(pc.if_else(odd, "", texts), " "))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(at):
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
        for i, whole in zip(at, self.library.encode(texts.take(pa.array(at)).to_pylist(), num_threads=1)):
            parts[i] = whole
        return self._joined(parts)

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in parts)]), offsets

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end byte in the source of each id's piece."""
        normal, align = self.normalizer.normalize(text)
        lengths = self.lengths[ids]
        if self.unknown >= 0 and (lengths == 0).any():  # an unknown piece has the surface that the library names
            lengths = np.array([len(normal_piece.encode()) for normal_piece in self.library.encode(text, out_type=str)], np.int64)
        ends = np.cumsum(lengths)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        return align[ends - lengths], align[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", outputs: tuple[str, ...] = ("ids", "spans")) -> DataFrame:
    """df's columns `keep` with, as asked for in outputs:

    ids: ids array<int>; spans: starts and ends array<int>, the original UTF-8 bytes of each id's piece; decoded: the
    library's decoding of the ids; digest: n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (of starts and ends as
    little-endian i32).

    Texts are encoded whole, without begin or end ids and without sampling, where they are read: no shuffle. A null
    text is empty and has no ids; repeated rows give repeated rows; an empty table gives none."""
    kinds = {"ids": "ids array<int>", "spans": "starts array<int>, ends array<int>", "decoded": "decoded string", "digest": "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"}
    kept = [f"`{name}` {kind}" for name, kind in df.select(*keep).dtypes]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        own = codec(path)
        for whole in batches:
            for batch in text_chunks(whole, "_text", STEP_BYTES):
                texts = texts_of(batch, "_text")
                ids, offsets = own.encode(texts)
                parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
                strings = texts.to_pylist()
                spans = [own.spans(t, x) for t, x in zip(strings, parts)] if {"spans", "digest"} & {*outputs} else []
                decoded = [own.decode(x) for x in parts] if {"decoded", "digest"} & {*outputs} else []
                columns, names = [batch.column(i) for i in range(len(keep))], list(keep)

                def add(name: str, values, kind) -> None:
                    columns.append(pa.array(values, kind))
                    names.append(name)

                for output in outputs:
                    if output == "ids":
                        add("ids", parts, pa.list_(pa.int32()))
                    elif output == "spans":
                        add("starts", [a.astype(np.int32) for a, _ in spans], pa.list_(pa.int32()))
                        add("ends", [b.astype(np.int32) for _, b in spans], pa.list_(pa.int32()))
                    elif output == "decoded":
                        add("decoded", decoded, pa.string())
                    else:
                        add("n_tokens", np.diff(offsets), pa.int64())
                        add("ids_sha256", [hashlib.sha256(",".join(map(own.decimals.__getitem__, x.tolist())).encode()).hexdigest() for x in parts], pa.string())
                        add("decoded_sha256", [hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
                        add("spans_crc32", [zlib.crc32(b.astype("<i4").tobytes(), zlib.crc32(a.astype("<i4").tobytes())) for a, b in spans], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return map_arrow(docs, encode, ", ".join([*kept, *(kinds[x] for x in outputs)]))


def decode_documents(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """df's columns `keep` with decoded string: the library's decoding of the ids (null: the empty text)."""
    kept = [f"`{name}` {kind}" for name, kind in df.select(*keep).dtypes]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).library.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    rows = df.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    return map_arrow(rows, decode, ", ".join([*kept, "decoded string"]))
