"""Shared plumbing: reading tables, the shared scratch folder, and word hashing on byte buffers.

Words are maximal runs without the six ASCII white-space characters (0x20, 0x09-0x0D).
Hashing works on byte buffers with numpy in slices of bounded length, so that neither a
batch of many texts nor one very long text needs more than a few megabytes of scratch.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text hashed at a time.
SLICE_BYTES = 1 << 20
#: Bytes of text handed to a kernel at a time.
GROUP_BYTES = 4 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_MASK = (1 << 64) - 1
#: Odd multipliers of the two polynomial hashes of a word's bytes, and of a window's words.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WINDOW_BASE = 0xA24BAED4963EE407


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a temporary folder is made; on a cluster,
    where executors could not see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        own = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return jsc.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Paths of the tables that are still in the shared folder.
_TABLES: dict[str, None] = {}


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors.

    ``release`` removes it once nothing reads it any more; what is left goes when the process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    _TABLES[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def renewed(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df``, which reads nothing but the stored table ``of``, as that table."""
    df.stored_at = of.stored_at
    return df


def release(*tables: DataFrame | str) -> None:
    """Delete stored tables whose successors are written, and let go of the shuffle files that only they needed."""
    for table in tables:
        path = table if isinstance(table, str) else table.stored_at
        _TABLES.pop(path, None)
        _delete(path)
    gc.collect()
    if SparkContext._jvm is not None:
        SparkContext._jvm.System.gc()  # the cleaner drops shuffle files of plans that are collected


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    if jvm is None:
        return
    conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def scratch():
    """Tables stored inside are released at the end, but for those in the list that is handed out."""
    before, keep = set(_TABLES), []
    try:
        yield keep
    finally:
        kept = {x.stored_at for x in keep}
        release(*[x for x in _TABLES if x not in before and x not in kept])


@atexit.register
def _sweep() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        for path in list(_TABLES):
            _delete(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's bytes, 0 where it has none; it decides numbers of partitions, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


# ---------------------------------------------------------------- Arrow batches


def text_groups(batch: pa.RecordBatch, column: str = "text", most: int = GROUP_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of rows whose texts hold about ``most`` bytes: (first row, end row, bytes, offsets into them). Null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = memoryview(data) if data is not None else memoryview(b"")
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, bytes(raw[offsets[first] : offsets[end]]), offsets[first : end + 1] - offsets[first]
        first = end


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & _MASK, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = powers(base, max(n, 1 << 12))
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    power, back = _power(base, SLICE_BYTES + 1), _power(inverse(base), SLICE_BYTES + 1)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            at = int(starts[i])
            j = int(np.searchsorted(ends, at + SLICE_BYTES, side="right"))
            if j <= i:  # one span longer than a slice: fold it slice by slice
                h = 0
                for k in range(at, int(ends[i]), SLICE_BYTES):
                    part = buf[k : min(k + SLICE_BYTES, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                    s = int((part * power[: len(part)]).sum(dtype=np.uint64))
                    h = (h + s * pow(base, k - at, 1 << 64)) & _MASK
                out[i] = h
                i += 1
                continue
            part = buf[at : int(ends[j - 1])].astype(np.uint64)
            part += np.uint64(1)
            part *= power[: len(part)]
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(part, out=total[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (total[e] - total[s]) * back[s]
            i = j
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts in ``buf``, and for each text the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_WHITE[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False  # a text's start ends the last one's word
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    cuts = inner[(inner > 0)]
    after[cuts - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes of their differences, which compress well."""
    d = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    return d.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
