"""What the training-data operators share: reading tables, cutting lineage in the shared folder, ragged arrays."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of an Arrow function holds at a time.
CHUNK_BYTES = 2 << 20
_own_dirs: dict[str, str] = {}
_registered: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _own_dirs[app]


def _remove_at_exit(spark: SparkSession, root: str) -> None:
    if root in _registered:
        return
    _registered.add(root)

    def remove() -> None:
        jsc = getattr(spark.sparkContext, "_jsc", None)
        if jsc is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage (a lost executor costs no more than the tasks after the table) and fixes what is not
    deterministic, as the assignment of rows to range partitions. The tables go when the driver ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"
    _remove_at_exit(spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch between Spark and Python, unless the session says otherwise.
BATCH_BYTES = 2 << 20


def _release() -> None:
    """Gives freed memory back, so that an idle worker doesn't hold what its last task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with batches that are bounded by bytes, not by rows alone."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == f"{64 << 20}b":  # Spark's default
        conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:  # also where a limit ends the task early
            _release()

    return df.mapInArrow(run, schema)


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with null as the empty text."""
    return pc.fill_null(batch.column(column), "")


def ragged_take(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """table[starts[i] : starts[i] + lengths[i]] for all i, joined; and the offsets of the parts in it."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return table[at], offsets


def list_parts(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The joined values of a list array and their offsets, from 0 also where the array is a slice."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def hash_sample(df: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """About n of df's `total` rows, n at most: those whose keys hash lowest, with the hash as h. Rows above a bound on
    the hash are dropped first, so that no task sends on more than its share of the sample."""
    share = min(1.0, (n + 6 * n**0.5 + 12) / max(1, total))
    hashed = df.withColumn("h", F.xxhash64(*keys))
    return hashed.where(F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy("h").limit(n)


class WordMemo:
    """Encodes texts that are given as words, where a word's ids don't depend on its neighbours.

    Words seen before come from a memo of bounded size, as little-endian i32; it only saves time, results don't depend
    on it."""

    def __init__(self, encode_words: Callable[[list[str]], list], limit: int = 100_000, longest: int = 48):
        self.encode_words, self.limit, self.longest = encode_words, limit, longest
        self.memo: dict[str, bytes] = {}

    def lookup(self, words: list[str]) -> list[bytes]:
        found = list(map(self.memo.get, words))
        missed = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missed, self.encode_words([words[i] for i in missed]) if missed else []):
            found[i] = ids = ids if isinstance(ids, bytes) else array("i", ids).tobytes()
            if len(self.memo) < self.limit and len(words[i]) <= self.longest:
                self.memo[words[i]] = ids
        return found

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the offset of each text's ids."""
        flat, offsets = list_parts(words)
        if not len(flat):
            return np.zeros(0, np.int32), offsets
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy()
        found = self.lookup(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, upto = ragged_take(np.frombuffer(b"".join(found), np.int32), (np.cumsum(lengths) - lengths)[at], lengths[at])
        return ids, upto[offsets]


def arrow_batches(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal keys of a partition that is sorted by key, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def prefix_offsets(totals: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """(part, total, ...) in any order -> (part, sum of the totals of lower parts, ...)."""
    out, running = [], None
    for part, *sums in sorted(totals):
        running = running or [0] * len(sums)
        out.append((part, *running))
        running = [a + b for a, b in zip(running, sums)]
    return out


#: Ids that may be broadcast to drop or keep rows by (about 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """df's rows whose id is not among `ids` (one column named id_col); rows with a null id stay."""
    found = materialize(ids.where(F.col(id_col).isNotNull()).distinct(), "ids")
    few = found.count() <= BROADCAST_IDS
    return df.join(F.broadcast(found) if few else found, id_col, "left_anti").select(*df.columns)
