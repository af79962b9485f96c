"""Helpers of the training-data operators: shared storage, batches, hashing of words and shingles."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_base
from ..ship import ship

ARROW_ROWS = "512"
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as documents may be long; the executors get this package if they lack it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_base(spark)


_made: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    """Tables that results were still read from go with the driver, if its session is still there."""
    for path, spark in _made.items():
        try:
            if spark.sparkContext._jsc is not None:
                discard(spark, path)
        except (Py4JError, OSError, AttributeError):
            return


def trim_driver(spark: SparkSession) -> None:
    """The driver's JVM returns freed native memory to the system, as many plans leave scattered pieces of it; not every JVM knows how."""
    jvm = spark.sparkContext._jvm
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        called = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        called[0], called[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(beans, called)
    except Py4JError:
        pass


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    trim_driver(spark)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables of materialise() that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def give_back() -> None:
    """Return free memory to the system at the end of a partition, as workers live on next to others."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of a string column, or one row."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield b.slice(at, end - at)
            at = end
    give_back()


# -- words and shingles -------------------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18
_WORD = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), (95,), range(128, 256)):
    _WORD[list(_r)] = True
_COEF = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F)]
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            a = np.full(size, b, dtype=_U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=_U))
        if n > _PIECE + 1:
            return tuple(out)
        _powers = tuple(out)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowercased bytes of all texts, start and end of each word, index of the first word of each text and of the end).

    A word is a maximal run of ASCII letters, digits, underscores or non-ASCII characters of the
    lowercased text; a null text has no words.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    wide = pa.types.is_large_string(low.type)
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int64 if wide else np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = low.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(low) + 1, np.int64)
    word = _WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return raw, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans lie in order and don't overlap."""
    out = np.empty(len(starts), dtype=_U)
    k = 0
    while k < len(starts):  # pieces of whole words keep the temporary arrays small
        a = starts[k]
        j = max(k + 1, int(np.searchsorted(ends, a + _PIECE, side="right")))
        b = ends[j - 1]
        up, down = _power_tables(b - a + 1)
        total = np.zeros(b - a + 1, dtype=_U)
        np.cumsum((raw[a:b].astype(_U) + _U(1)) * up[: b - a], out=total[1:])
        s, e = starts[k:j] - a, ends[k:j] - a
        out[k:j] = (total[e] - total[s]) * down[s] + (e - s).astype(_U) * _COEF[7]
        k = j
    return mix64(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and of the end)."""
    raw, starts, ends, bounds = word_spans(texts)
    return span_hashes(raw, starts, ends), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each run of width words, first shingle of each text and end); repeats stay.

    A text of fewer words than width, but one at least, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], dtype=_U)
    full = len(words) - width + 1
    if full > 0:
        h = np.zeros(full, dtype=_U)
        for k in range(width):
            h += words[k : k + full] * _COEF[k]
        ok = counts >= width
        take = np.repeat(bounds[:-1][ok] - at[:-1][ok], n[ok]) + np.flatnonzero(np.repeat(ok, n))
        out[np.repeat(ok, n)] = h[take]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = _U(0)
        with np.errstate(over="ignore"):
            for k, w in enumerate(words[bounds[i] : bounds[i + 1]]):
                h += w * _COEF[k]
            h += _U(counts[i]) * _COEF[6]
        out[at[i]] = h
    return mix64(out), at


def held_out(doc_id) -> object:
    """Column: the row is not to be learnt from, as crc32 of its id's text leaves 2 when divided by 4; false for a null id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
