"""Shared pieces: materialised intermediates, byte-level tokenising in numpy, grouped Arrow streams.

Texts reach Python as Arrow buffers and stay there: a batch is one byte array plus offsets, cut into chunks of
about :data:`CHUNK` bytes so that a worker's memory does not depend on the batch or on the number of documents.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text handled at once inside a Python worker.
CHUNK = 1 << 19

_U = np.uint64


# --------------------------------------------------------------------------- materialised intermediates
#: With this setting a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that Spark hands to a Python worker at once; 10,000 rows of text are some 30 MB, of which the JVM and the
#: worker hold copies. A longer row stands alone.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kindred-shared-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: it cuts the lineage and survives lost executors. What was
    shuffled for it is deleted at once; else it would stay until the driver happens to collect its garbage. Rows reach
    Python in batches of a few MB."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred-{uuid.uuid4().hex}"
    ours = {CLEANUP: "true"} | BATCH
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on rows reach Python in batches of a few MB in all of this session's plans, those that are not stashed too.
    Spark takes the setting when a plan runs, so what returns a plan for its caller to run has to leave it set."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def unstash(df: DataFrame) -> None:
    """Delete a stashed table once nothing that is still to run reads it."""
    _remove(df.sparkSession, df._kindred_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone already
        pass


#: Most bits of a bitmap of ids.
BITMAP = 1 << 26


def by_bitmap(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` (a long or null) is in the column of that name of ``ids``, and a few others: what a
    bitmap of hashed ids, at most 8 MB, lets through; and all other rows, none of which has a key in ``ids``.

    ``ids`` is read twice. Rows are not shuffled, but ``df`` is read for each part.
    """
    bits = min(BITMAP, max(1 << 15, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("long")), F.lit(bits))
    at = ids.select((place + 1).alias("at"))
    maps = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("m"))
    maps = df.sparkSession.createDataFrame(maps.collect(), "b long, m binary")
    where, bucket, bitmap = apart(df.columns, "_at", "_b", "_m")
    # a bucket has 2**15 bits; the byte is read by way of its digits
    met = df.withColumn(where, place).join(F.broadcast(maps.toDF(bucket, bitmap)), F.shiftright(where, 15) + 1 == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(F.col(where) % (1 << 15), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(`{where}` % 8 AS int))")) != 0, F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return met.where(found).select(own), met.where(~found).select(own)


# --------------------------------------------------------------------------- memory of the workers
def released(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` for mapInArrow; what it has freed goes back to the system when its task ends. Workers are used again, and
    else each keeps the memory of the largest task that it ever had, however small the later ones are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give back the memory that Arrow and the C library hold for later use (the latter where it is glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --------------------------------------------------------------------------- columns
def text_col(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def row_key(doc_id: str, text: str) -> list[Column]:
    """(id, text hash): tells apart rows that share an id but not a text; equal rows get equal keys."""
    return [F.col(f"`{doc_id}`").cast("long").alias("_id"), F.xxhash64(text_col(text)).alias("_th")]


def fold5(doc_id: str) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text, so its fold is 0."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % 5


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns whose names (ignoring case) the operator is about to add."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def apart(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that are not ``taken`` (ignoring case)."""
    low, out = {n.lower() for n in taken}, []
    for n in wanted:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def with_helpers(df: DataFrame, outs: Iterable[str], **helpers: Column) -> tuple[DataFrame, list[str]]:
    """``df`` less the columns that ``outs`` replaces, plus helper columns last, and the names these got.

    Helpers may read replaced columns, and their names differ from all others.
    """
    outs = list(outs)
    kept = without(df, outs).columns
    names = apart([*kept, *outs], *helpers)
    return df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for c, n in zip(helpers.values(), names, strict=True)]), names


# --------------------------------------------------------------------------- Arrow text
def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) else "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, at, data = arr.buffers()
    offs = np.frombuffer(at, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


# --------------------------------------------------------------------------- hashes
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift); changes its argument in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(ODD[63])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position, from which any substring's hash follows."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=s[1:])
    return s


def between(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of values[start:end], by the prefix sums of :func:`running`."""
    return (s[end] - s[start]) * powers(len(s))[1][start]


# --------------------------------------------------------------------------- words
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes other than space and \\t..\\r (or ``gaps``); runs never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~gaps[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = ink[cut]
    last[cut - 1] = ink[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = between(running(BYTE[data]), start, end)
    h ^= (end - start).astype(np.uint64) * ODD[60]
    return mix(h)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct k-word shingles, rows ascending, hashes ascending within a row.

    A-Z are lower-cased; a row with fewer than k words has its whole sequence as its one shingle; a row without words
    has none.
    """
    low = LOWER[data]
    start, end, row = words(low, offs)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = word_hashes(low, start, end)
    out_h, out_r = [], []
    if len(w) >= k:
        h = w[: len(w) - k + 1] * ODD[0]
        for j in range(1, k):
            h += w[j : len(w) - k + 1 + j] * ODD[j]
        ok = row[: len(w) - k + 1] == row[k - 1 :]
        out_h.append(mix(h[ok]))
        out_r.append(row[: len(w) - k + 1][ok])
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[heads, len(row)])
    few = heads[count < k]
    if len(few):
        m = count[count < k]
        h = m.astype(np.uint64) * ODD[61]
        for j in range(k - 1):
            has = m > j
            h[has] += w[few[has] + j] * ODD[j + 8]
        out_h.append(mix(h))
        out_r.append(row[few])
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    by = np.lexsort((h, r))
    h, r = h[by], r[by]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
    return h[new], r[new]


# --------------------------------------------------------------------------- grouped streams
def complete_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups, about ``rows`` rows or one group each, from batches sorted by ``keys``."""
    held: list[pa.Table] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
        if n < rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        same = np.ones(t.num_rows, bool)
        for k in keys:
            same &= _same_as_last(t.column(k))
        cut = int(np.argmax(same))
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = [t], t.num_rows if cut else 0
    if held:
        t = pa.concat_tables(held).combine_chunks()
        if t.num_rows:
            yield t


def _same_as_last(col: pa.ChunkedArray) -> np.ndarray:
    last = col[-1]
    if not last.is_valid:
        return pc.is_null(col).to_numpy()
    return pc.fill_null(pc.equal(col, last), False).to_numpy()


def heads(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Start of each group of equal consecutive keys, and the row count at the end."""
    new = np.zeros(t.num_rows, bool)
    if t.num_rows:
        new[0] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), t.num_rows]


def widened(df: DataFrame, ddl: str) -> tuple[T.StructType, pa.Schema]:
    """The schema of ``df`` with the columns of ``ddl`` after its own, for Spark and for Arrow."""
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(ddl).fields)
    return schema, to_arrow_schema(schema)
