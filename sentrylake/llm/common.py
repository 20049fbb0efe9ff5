"""What the corpus operators share: picking columns, reading tables, files in the shared folder, hashing words."""

from __future__ import annotations

import ctypes
import io
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sentrylake.session import scratch_path

#: Odd multiplier of the polynomial over bytes, and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers_lock = threading.Lock()
_powers: tuple[np.ndarray, np.ndarray] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``new_name="old name"`` pairs, found by exact spelling and position.

    Extra columns whose names differ in case only, or that repeat a name, do no harm: of equally
    spelled columns the first counts.
    """
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[plain[f"_c{names.index(old)}"].alias(new) for new, old in columns.items()])


def partitions(df: DataFrame) -> int:
    """How many tasks a shuffle of this session has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """File system and path of a URI in the shared folder; for tasks, which have no JVM at hand."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks, one after another, and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving back memory when a task ends."""

    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def write_array(uri: str, array: np.ndarray) -> str:
    """Write an array to the shared folder; tasks get its URI in place of a copy each."""
    held = io.BytesIO()
    np.save(held, array)
    fs, path = open_fs(uri)
    with fs.open_output_stream(path) as f:
        f.write(held.getbuffer())
    return uri


#: Arrays that a worker has at hand; mapped ones cost it only what it reads.
_HELD = 64
_arrays: dict[str, np.ndarray] = {}


def load_array(uri: str) -> np.ndarray:
    """An array of the shared folder, mapped where that is a mounted one, so that workers of a machine share it."""
    if uri not in _arrays:
        from pyarrow import fs

        store, path = open_fs(uri)
        while len(_arrays) >= _HELD:
            _arrays.pop(next(iter(_arrays)))
        if isinstance(store, fs.LocalFileSystem):
            _arrays[uri] = np.asarray(np.load(path, mmap_mode="r"))
        else:
            with store.open_input_stream(path) as f:
                _arrays[uri] = np.load(io.BytesIO(f.read()))
    return _arrays[uri]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    with _powers_lock:
        if _powers is None or len(_powers[0]) < n:
            size = max(1 << 16, 1 << int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                up = np.full(size, _BASE, np.uint64)
                up[0] = 1
                down = np.full(size, _INVERSE, np.uint64)
                down[0] = 1
                up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if size > 1 << 19:  # a very long text pays for its own tables, the worker doesn't keep them
                return up, down
            _powers = (up, down)
        return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of a public hash)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of ``data``; equal spans have equal hashes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        terms = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)]
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z lower-cased; none for a null text."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each starts and ends."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), ends - sizes, ends


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hash of every run of ``k`` words in order; of the whole sequence if there are fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    data, starts, ends = word_spans(words)
    if len(words) < k:
        return span_hashes(data, starts[:1], ends[-1:])
    return span_hashes(data, starts[: len(words) - k + 1], ends[k - 1 :])
