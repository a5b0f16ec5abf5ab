"""Scratch tables, batch helpers, word hashing and worker caches shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a task turns into Python objects at once.
SLICE_BYTES = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where a local session has none (single-machine tests), a folder is set once;
    on a cluster, where executors would not see it, that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomkb-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Tables that an operator writes to the shared folder to cut lineage.

    ``write`` runs the plan once and returns a scan of its rows; executors may
    be lost afterwards. ``drop`` removes a table that no later plan reads; what
    a lazy result still reads is removed when the driver's Python ends, after
    the session's jobs are cancelled.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.base}/{name}")

    def clear(self) -> None:
        try:
            self.spark.sparkContext.cancelAllJobs()
            self._delete(self.base)
        except Exception:  # the session may be closed by then
            pass

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Rows up to which a table with a row for each task or part of a scan is sent to all executors.
SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` of narrow rows, marked for broadcast if it has at most ``most``; joined as Spark sees fit beyond."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of ``column`` each; one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` consecutive word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, size):
        out += words[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64))
    return mix(out)


#: Bytes up to which a word is hashed eight bytes at a time, all words of a slice together.
LANE_WORDS = 64
#: What remains of a lane of eight bytes by how many belong to the word.
LANE_MASKS = np.array([0, *[(1 << 8 * k) - 1 for k in range(1, 8)], 2**64 - 1], np.uint64)


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each row's begin and the last one's end; nulls are empty."""
    raw = column.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def hashed_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a string column's words in order, and where each row's begin and the last one's end.

    Words are runs of bytes other than the ASCII white space; ``lower`` takes
    A-Z for a-z. A hash covers the word's length and all its bytes, eight at a
    time through a bijection, so only chance makes two words' hashes equal.
    """
    HELD.only("words")  # hashing needs no cache
    data, ends = _text_bytes(column)
    n = len(data)
    text = np.full(n + 8, 32, np.uint8)
    text[:n] = data
    if lower:
        text += ((text - np.uint8(65)) < 26).astype(np.uint8) << 5
    inside = ~((text[:n] == 32) | ((text[:n] - np.uint8(9)) < 5))
    edges = ends[ends < n]  # a row's first byte begins a word, whatever stands before it
    begins = np.empty(n, bool)
    begins[:1], begins[1:] = True, ~inside[:-1]
    begins[edges] = True
    stops = np.empty(n, bool)
    stops[-1:], stops[:-1] = True, ~inside[1:]
    stops[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(inside & begins)
    sizes = np.flatnonzero(inside & stops) + 1 - starts
    lanes = np.ndarray((n + 1,), "<u8", text.data, strides=(1,))
    out = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (lanes[starts] & LANE_MASKS[np.minimum(sizes, 8)]))
    at, longest = 8, int(sizes.max(initial=0))
    while at < min(longest, LANE_WORDS):
        more = np.flatnonzero(sizes > at)
        lane = lanes[starts[more] + at] & LANE_MASKS[np.minimum(sizes[more] - at, 8)]
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + lane)
        at += 8
    if longest > LANE_WORDS:
        for k in np.flatnonzero(sizes > LANE_WORDS).tolist():
            out[k] = xxhash.xxh3_64_intdigest(text[starts[k] : starts[k] + sizes[k]].tobytes())
    return out, np.searchsorted(starts, ends)


class Held(dict):
    """What one operator keeps from task to task in a Python worker; another operator's first use drops it."""

    owner: str | None = None

    def only(self, owner: str) -> None:
        """Drop what another operator has kept."""
        if self.owner != owner:
            self.clear()
            self.owner = owner

    def of(self, owner: str, key, make):
        self.only(owner)
        if key not in self:
            self[key] = make()
        return self[key]


HELD = Held()
