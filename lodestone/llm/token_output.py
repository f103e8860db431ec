"""Token-ID output: binary shard files of separately compressed documents under one shared zstandard dictionary.

A dataset has three tables, written by Spark's committer so that it can lie in any store and a failed or repeated
task leaves nothing behind:

* `dictionary`: one row, sha256 (hex) and content (bytes) of the dictionary.
* `files`: part int, seq int, low and high long (ids), n_docs long, n_tokens long, blob binary. A blob is one complete
  shard file.
* `manifest`: part int, before long: the ids of all documents in lower parts.

A shard file is HEADER (magic, sha256 of the dictionary, bytes an id, documents, first id's place in its part), then the
index (flags u8: 1 if the document has an id; doc_id i64; place of its first id u64; count of ids u32, for each
document; then count+1 offsets u64 of the compressed frames), then the frames. A document is read by its index entry
and its own frame alone; files are in ascending order of (part, seq)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, hash_sample, map_arrow, materialize, prefix_offsets, shuffle_partitions, text_chunks, texts_of

MAGIC = b"TIDZ0001"
HEADER = "<8s32sBIQ"
#: Documents from which the dictionary learns (those of the smallest id hashes).
SAMPLE_DOCS, DICTIONARY_BYTES, LEVEL = 1000, 64 << 10, 3
FILE_BYTES = 4 << 20
END_ID = 1


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Where the tokenizer's own rules cut a lower-case text, besides white space: before and after each of these.
CUTS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\x09-\x0d \p{L}\p{N}]+)"
#: Texts for which CUTS and a lowering letter by letter are exact: white space, printable ASCII and Latin letters below
#: U+0250 that are in normal form and have one lower letter, without the start of an added token.
PLAIN = r"^[\x09-\x0d -~\x{a1}-\x{12f}\x{131}-\x{24f}]*$"


def byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary has for each byte: itself if it is printable in Latin-1, else the
    next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


@lru_cache(maxsize=4)
def _memos(path: str) -> tuple[WordMemo, WordMemo]:
    """Of words of any text, and of pieces of plain texts."""
    tokenizer = _tokenizer(path)
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    merge, characters = tokenizer.model.tokenize, byte_characters()

    def pieces(words: list[str]) -> list[list[int]]:
        return [[t.id for t in merge(p if p.isascii() else p.encode().decode("latin-1").translate(characters))] if p else [] for p in words]

    return WordMemo(lambda words: [e.ids for e in batch(words, add_special_tokens=False)], limit=50_000), WordMemo(pieces, limit=400_000, longest=32)


def encode_texts(texts: pa.Array, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the offsets of each text's ids, with end_id after each.

    The vocabulary drops white space and no piece, normalisation or added token spans it, so a text's ids are its
    words' ids, and a plain text's are those that the library's merges make of its pieces."""
    words, pieces = _memos(path)
    plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
    cut = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, texts, "")), CUTS, r" \1 ")
    ids, offsets = pieces.encode(pc.ascii_split_whitespace(cut))
    odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    if len(odd):
        other, ends = words.encode(pc.ascii_split_whitespace(texts.take(pa.array(odd))))
        parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
        for i, a, b in zip(odd, ends, ends[1:]):
            parts[i] = other[a:b]
        ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def train_dictionary(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from the ids of a bounded sample of SAMPLE_DOCS whole documents, encoded where they lie. It bears on
    the size of the files, not on what is read from them. Too small samples give a plain-content dictionary."""
    kind = "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole):
                ids, offsets = encode_texts(texts_of(batch), path)
                yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].astype(kind).tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())], names=["ids"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = hash_sample(docs, SAMPLE_DOCS, docs.count(), "doc_id")
    samples = sorted(bytes(r["ids"]) for r in map_arrow(sample.select("text"), serialized, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or bytes(8)


def _encoder(path: str, dictionary: bytes):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        kind = "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in text_chunks(whole):
                ids, offsets = encode_texts(texts_of(batch), path)
                raw = ids.astype(kind).tobytes()
                width = np.dtype(kind).itemsize
                frames = [compressor.compress(raw[a:b]) for a, b in zip(offsets * width, offsets[1:] * width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.arange(row, row + len(frames))), pa.array(np.diff(offsets)), pa.array(frames, pa.binary())], names=["doc_id", "row", "n_tokens", "frame"])
                row += len(frames)

    return encode


def _packer(sha: bytes, width: int):
    def blob(docs: list[tuple], first: int) -> bytes:
        known = np.array([d is not None for d, _, _ in docs], np.uint8)
        doc_ids = np.array([d or 0 for d, _, _ in docs], "<i8")
        counts = np.array([n for _, n, _ in docs], "<u4")
        starts = (first + np.cumsum(counts, dtype=np.uint64) - counts).astype("<u8")
        frames = np.concatenate([[0], np.cumsum([len(f) for _, _, f in docs])]).astype("<u8")
        return b"".join([struct.pack(HEADER, MAGIC, sha, width, len(docs), first), known.tobytes(), doc_ids.tobytes(), starts.tobytes(), counts.tobytes(), frames.tobytes(), *(f for _, _, f in docs)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush():
            n, known = sum(d[1] for d in held), [d[0] for d in held if d[0] is not None]
            numbers = [pa.array([x], kind) for x, kind in ((part, pa.int32()), (seq, pa.int32()), (min(known, default=None), pa.int64()), (max(known, default=None), pa.int64()), (len(held), pa.int64()), (n, pa.int64()))]
            return pa.RecordBatch.from_arrays([*numbers, pa.array([blob(held, first)], pa.binary())], names=["part", "seq", "low", "high", "n_docs", "n_tokens", "blob"]), n

        for batch in batches:
            for doc in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("frame").to_pylist()):
                held.append(doc)
                size += len(doc[2]) + 21
                if size >= FILE_BYTES:
                    out, n = flush()
                    yield out
                    seq, first, held, size = seq + 1, first + n, [], 0
        if held:
            yield flush()[0]

    return pack


class TokenFiles:
    """A written dataset: its three tables."""

    def __init__(self, dictionary: DataFrame, files: DataFrame, manifest: DataFrame):
        self.dictionary, self.files, self.manifest = dictionary, files, manifest


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode df's texts (null: empty) with the tokenizer file at `path`, END_ID after each, and write them in ascending
    order of id (null ids first, repeated ids in order of reading). Documents are encoded and compressed where they are
    read; only frames are shuffled. Other columns are ignored; an empty table gives no files."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(docs, path)
    sha = hashlib.sha256(dictionary).digest()
    width = 2 if _tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    frames = materialize(map_arrow(docs, _encoder(path, dictionary), "doc_id long, row long, n_tokens long, frame binary"), "frames")
    ordered = frames.repartitionByRange(shuffle_partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row")
    files = materialize(map_arrow(ordered, _packer(sha, width), "part int, seq int, low long, high long, n_docs long, n_tokens long, blob binary"), "token-files")
    totals = files.groupBy("part").agg(F.sum("n_tokens")).collect()
    manifest = spark.createDataFrame(prefix_offsets([tuple(r) for r in totals]), "part int, before long")
    return TokenFiles(spark.createDataFrame([(sha.hex(), bytearray(dictionary))], "sha256 string, content binary"), files, manifest)


class ShardFile:
    """Random access to one shard file."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, sha, width, n, self.first = struct.unpack_from(HEADER, blob)
        if magic != MAGIC or sha != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or another dictionary's")
        self.blob, self.kind, at = blob, f"<u{width}", struct.calcsize(HEADER)
        parts = []
        for kind, count in (("u1", n), ("<i8", n), ("<u8", n), ("<u4", n), ("<u8", n + 1)):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        (self.known, self.doc_ids, self.starts, self.counts, self.frames), self.data = parts, at
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """Ids of document i, from its frame alone."""
        a, b = self.data + int(self.frames[i]), self.data + int(self.frames[i + 1])
        return np.frombuffer(self.reader.decompress(self.blob[a:b], max_output_size=int(self.counts[i]) * int(self.kind[-1])), self.kind)


def find_documents(data: TokenFiles, doc_ids: list[int]) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents with these ids, each read from its own frame: files whose range
    of ids holds none of them are skipped by the scan's statistics, and other documents' frames stay compressed."""
    wanted = sorted(set(doc_ids))
    dictionary = bytes(data.dictionary.select("content").first()[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, before in zip(batch.column("blob").to_pylist(), batch.column("before").to_pylist()):
                file = ShardFile(blob, dictionary)
                at = np.flatnonzero((file.known == 1) & np.isin(file.doc_ids, wanted))
                ids = [file.ids(i).astype("<u4") for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[at]), pa.array(file.starts[at].astype(np.int64) + before), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "ids"])

    near = F.lit(False)
    for doc_id in wanted:
        near = near | ((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
    placed = data.files.where(near).select("part", "blob").join(F.broadcast(data.manifest), "part").select("blob", "before")
    return map_arrow(placed, read, "doc_id long, start long, n_tokens long, ids array<long>")


def read_token_files(data: TokenFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over the ids as little-endian u32), and ids
    if asked for, from the files."""
    dictionary = bytes(data.dictionary.select("content").first()[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, before in zip(batch.column("blob").to_pylist(), batch.column("before").to_pylist()):
                file = ShardFile(blob, dictionary)
                ids = [file.ids(i).astype("<u4") for i in range(len(file))]
                columns = [pa.array(file.doc_ids, mask=file.known == 0), pa.array(file.starts.astype(np.int64) + before), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = data.files.select("part", "blob").join(F.broadcast(data.manifest), "part").select("blob", "before")
    return map_arrow(placed, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
