"""What the operators share: reading, checkpoints, and words of whole Arrow columns as hashes.

Text is handled as UTF-8 bytes. A byte above 0x7F always belongs to a word, so classes
of code points that only split at ASCII become classes of bytes, and one pass of numpy
finds the words of thousands of documents at once.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 17
BATCH_ROWS = "250"
ROWS_TO_A_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Few rows to an Arrow batch, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """run, a function of Arrow batches, giving free memory back to the system when its task ends.

    Workers live on from stage to stage, and what one has freed would count beside what the next one needs.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there.

    The folder is the one named by spark.checkpoint.dir. Only a local session that names
    none gets a folder of its own, removed at exit.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="foliospark-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """df from the checkpoint folder in as few partitions as its rows need, and their number.

    For narrow rows: what a task writes of them for a shuffle shouldn't be thousands of files of a few bytes.
    """
    out = cut(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // ROWS_TO_A_TASK))), n


# ---------------------------------------------------------------- bytes, words, hashes

_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _POWERS["up"][:n], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fold_ascii() -> np.ndarray:
    """Byte by byte, A-Z to a-z."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


FOLD = fold_ascii()
#: Bytes of a word: all but white space; letters, digits and everything beyond ASCII.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80 for b in range(256)])
ALNUM_LOWER_ONLY = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


class Words:
    """Words of some texts: where each begins and ends in the bytes, the first word of each text, hashes."""

    __slots__ = ("data", "offsets", "starts", "ends", "first", "hashes")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = FOLD):
        self.data, self.offsets = fold[data], offsets
        n = len(data)
        inside = is_word[self.data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = power_tables(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_HASH[self.data] * up, out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def runs(self, length: int) -> np.ndarray:
        """A hash for each run of so many words, by its first word; runs may cross texts."""
        n = max(0, len(self.hashes) - length + 1)
        h = np.zeros(n, np.uint64)
        for k in range(length):
            h = h * _WORD_BASE + self.hashes[k : k + n]
        return mix(h + np.uint64(length))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, in one array."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
