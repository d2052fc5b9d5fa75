"""Shared pieces of the llm operators: shared-folder tables, Arrow text access, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
CHUNK_BYTES = 2 << 20

#: White space of the word contracts: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_KEYS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[65:91] = BYTE_KEYS[97:123]
BASE = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_BLOCK = CHUNK_BYTES
_powers: dict[int, np.ndarray] = {}


_caches: dict[str, Callable[[], None]] = {}
_working: list[str] = []


def caches(operator: str, clear: Callable[[], None]) -> None:
    """Register how to clear what a worker keeps for an operator between tasks."""
    _caches[operator] = clear


def working(operator: str) -> None:
    """A task of an operator begins: a worker, which serves many, lets go of what it kept for others and gives memory back."""
    if _working != [operator]:
        for name, clear in _caches.items():
            if name != operator:
                clear()
        _working[:] = [operator]
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; only a local session (tests) may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    if at.startswith("file:/") and not at.startswith("file://"):
        at = at.removeprefix("file:")
    return at if "://" in at else f"file://{at}"


def opened(uri: str, mode: str):
    """A stream in the shared folder, from a driver or executor; mode "rb", "wb" or "map" (random access)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None) if mode == "rb" else system.open_input_file(path)


@contextmanager
def published(uri: str):
    """A stream whose file appears under its name, whole, when the block ends well.  A file that another try of the task left stays or is replaced."""
    from pyarrow import fs

    part = f"{uri}.{uuid.uuid4().hex}"
    with opened(part, "wb") as out:
        yield out
    system, path = fs.FileSystem.from_uri(part)
    name = path.removesuffix(part[len(uri) :])
    try:
        system.move(path, name)
    except OSError:
        if system.get_file_info(name).type != fs.FileType.File:
            raise
        system.delete_file(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; the driver's JVM deletes it at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Deal rows out evenly where the input has fewer partitions than the session would shuffle into."""
    return df.repartition(at_least) if at_least else df.repartition()


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that an operator's outputs replace."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def crc_bucket(column: str, n: int):
    """crc32 of the id as text modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def text_slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES):
    """Slices of a batch of about `limit` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = arrow_bytes(batch.column(column))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield batch.slice(lo, hi - lo)
        lo = hi


def arrow_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, where, data = array.buffers()
    if where is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and for each document its first word's index (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[inner] = solid[inner]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    stops[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16 if have is None else min(2 * len(have), _BLOCK + 1))
        grown = np.full(size, base, np.uint64)
        grown[0] = 1
        _powers[base] = have = np.cumprod(grown, dtype=np.uint64)
    return have


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = LOWER_KEYS) -> np.ndarray:
    """64-bit hash of each span of bytes, by differences of a running polynomial; equal bytes hash alike anywhere."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = int(np.searchsorted(ends, first + _BLOCK, "right"))
        if hi <= lo:  # one span longer than a block: piece by piece
            total, factor, step = 0, 1, pow(BASE, _BLOCK, 1 << 64)
            for at in range(first, int(ends[lo]), _BLOCK):
                part = data[at : min(at + _BLOCK, int(ends[lo]))]
                total += factor * int((keys[part] * powers(BASE, len(part))[: len(part)]).sum(dtype=np.uint64))
                factor = factor * step % (1 << 64)
            out[lo] = total % (1 << 64)
            lo += 1
            continue
        part = data[first : int(ends[hi - 1])]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(keys[part] * powers(BASE, len(part))[: len(part)], out=run[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = (run[e] - run[s]) * powers(BASE_INV, len(part) + 1)[s]
        lo = hi
    return mix(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` words of one text; of the whole text where it has fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        total = n
        for w in words.tolist():
            total = (total * BASE + w) % (1 << 64)
        return mix(np.array([total], np.uint64))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(BASE) + words[k : k + n - width + 1]
    return mix(total)


caches("hashes", _powers.clear)
