"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A rolling polynomial over word hashes gives a 64-bit hash of every window, a second one with another base 16 bits more. Each map task
keeps, of equal hashes in one chunk of documents, only the smallest doc_id's (the others are
covered already, and say so), and sends the rest in byte-packed blocks to the bucket that owns
the hash. A bucket sees every chunk's smallest doc_id of a hash, so it knows which documents
repeat a window of a smaller doc_id, and sends each document its covered hashes. There, covered
windows merge into maximal removal intervals of words.

Cost: one shuffle of about 10 bytes a window, one of the texts (compressed). A window that a
third of all documents hold sends one entry a chunk, not one a document. Buckets grow in
number with the input's bytes; nothing is collected or broadcast.

Equality of windows is that of both hashes, 80 bits: n windows give about n*n / 2**81 false matches
(10**-8 expected for 137 million windows, some forty for 10**13).

Defined results: null or empty text has no words, is kept as the empty string; texts under one
window keep all words; rows with equal doc_id don't cover each other and are each judged against
smaller ids; a row with null doc_id neither covers nor is covered; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_BLOCK = "part int, kind int, bucket long, doc_id long, ids binary, keys binary, text binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("keys", pa.binary()), ("text", pa.binary())])
#: kinds of rows: hashes for a bucket, covered hashes for documents, a document.
_HASHES, _COVERED, _DOCUMENT = 0, 1, 2

#: Bytes of input that one bucket of hashes, and one part of documents, may stand for; there are at least as many as shuffle partitions.
PART_BYTES = 256 << 20

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:long,end:long>>"


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of every window of consecutive words, from the words' hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.empty(len(words) + 1, np.uint64)
        total[0] = 0
        np.cumsum(words * C._power(C.WINDOW_BASE, len(words)), out=total[1:])
        return C.mix((total[window:] - total[:n]) * C._power(C.inverse(C.WINDOW_BASE), n))


def window_checks(words: np.ndarray, window: int) -> np.ndarray:
    """16 bits of a second hash of every window: another polynomial over other word hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint16)
    base = C.BASES[1]
    with np.errstate(over="ignore"):
        total = np.empty(len(words) + 1, np.uint64)
        total[0] = 0
        np.cumsum(C.mix(words ^ np.uint64(C.BASES[0])) * C._power(base, len(words)), out=total[1:])
        return (C.mix((total[window:] - total[:n]) * C._power(C.inverse(base), n)) >> np.uint64(48)).astype("<u2")


def _joined(keys: np.ndarray, checks: np.ndarray, sort: bool) -> bytes:
    """Keys (if sorted, as differences) and then their checks."""
    return (C.pack(keys) if sort else keys.astype("<u8").tobytes()) + checks.tobytes()


def _parted(data: bytes, sort: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 10 * 8
    return C.unpack(data[:n]) if sort else np.frombuffer(data[:n], "<u8").copy(), np.frombuffer(data[n:], "<u2").copy()


def _first(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where another window begins in sorted keys and checks."""
    out = np.ones(len(keys), bool)
    out[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return out


def _owner(doc_ids: np.ndarray, parts: int) -> np.ndarray:
    return (C.mix(doc_ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _covered_rows(ids: np.ndarray, keys: np.ndarray, checks: np.ndarray, parts: int) -> Iterator[dict]:
    """Covered hashes, one row for each partition of documents."""
    part = _owner(ids, parts)
    order = np.lexsort((keys, ids, part))
    part, ids, keys, checks = part[order], ids[order], keys[order], checks[order]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield {"part": int(part[a]), "kind": _COVERED, "bucket": 0, "doc_id": 0, "ids": _squeeze(ids[a:b]), "keys": _joined(keys[a:b], checks[a:b], False), "text": None}


def _squeeze(ids: np.ndarray) -> bytes:
    d = np.diff(ids, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(d)


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _each(batch: pa.RecordBatch, most: int = 256) -> Iterator[dict]:
    """The rows of a batch, few of them as Python objects at a time."""
    for i in range(0, len(batch), most):
        yield from batch.slice(i, most).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(v) for v in r.values() if isinstance(v, bytes | str))
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _hash_blocks(window: int, parts: int, chunk_windows: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys, checks, ids, held = [], [], [], 0

        def flush() -> Iterator[dict]:
            nonlocal held
            if not keys:
                return
            k, c, d = np.concatenate(keys), np.concatenate(checks), np.concatenate(ids)
            keys.clear()
            checks.clear()
            ids.clear()
            held = 0
            order = np.lexsort((d, c, k))
            k, c, d = k[order], c[order], d[order]
            first = _first(k, c)
            least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
            again = d > least
            if again.any():
                yield from _covered_rows(d[again], k[again], c[again], parts)
            k, c, d = k[first], c[first], d[first]
            bucket = (k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # ranges of the hash, so keys stay sorted
            edges = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64))
            for b in range(parts):
                if edges[b] < edges[b + 1]:
                    part = slice(edges[b], edges[b + 1])
                    yield {"part": b, "kind": _HASHES, "bucket": b, "doc_id": 0, "ids": _local_ids(d[part]), "keys": _joined(k[part], c[part], True), "text": None}

        for batch in batches:
            doc_ids = batch.column(0)
            known = np.asarray(doc_ids.is_valid())
            numbers = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
            for first, _end, data, offsets in C.text_groups(batch):
                buf = np.frombuffer(data, np.uint8)
                starts, ends, at = C.word_spans(buf, offsets)
                words = C.span_hashes(buf, starts, ends)
                for i in range(len(at) - 1):
                    if known[first + i] and at[i + 1] - at[i] >= window:
                        own = words[at[i] : at[i + 1]]
                        h, c = window_hashes(own, window), window_checks(own, window)
                        order = np.lexsort((c, h))
                        h, c = h[order], c[order]
                        new = _first(h, c)
                        h, c = h[new], c[new]
                        keys.append(h)
                        checks.append(c)
                        ids.append(np.full(len(h), numbers[first + i], np.int64))
                        held += len(h)
                        if held >= chunk_windows:
                            yield from flush()
        yield from flush()

    return lambda batches: _batches(rows(batches), _BLOCK_ARROW)


def _local_ids(ids: np.ndarray) -> bytes:
    """The distinct ids once, then a small index for each entry."""
    distinct, local = np.unique(ids, return_inverse=True)
    kind = np.uint16 if len(distinct) <= 1 << 16 else np.uint32
    head = _squeeze(distinct)
    return np.array([len(head), np.dtype(kind).itemsize], "<u4").tobytes() + head + local.astype(kind).tobytes()


def _read_ids(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:8], "<u4")
    return _expand(data[8 : 8 + n])[np.frombuffer(data[8 + n :], f"<u{width}")]


def _count_buckets(parts: int):
    """Rows come ordered by bucket; one bucket is held at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, keys, ids = None, [], []

        def flush() -> Iterator[dict]:
            if len(keys) > 1:
                k, c, d = np.concatenate([x for x, _ in keys]), np.concatenate([x for _, x in keys]), np.concatenate(ids)
                order = np.lexsort((d, c, k))
                k, c, d = k[order], c[order], d[order]
                first = _first(k, c)
                again = d > d[np.flatnonzero(first)][np.cumsum(first) - 1]
                if again.any():
                    yield from _covered_rows(d[again], k[again], c[again], parts)
            keys.clear()
            ids.clear()

        for batch in batches:
            for r in _each(batch):
                if r["kind"] == _COVERED:
                    yield r
                    continue
                if r["bucket"] != at:
                    yield from flush()
                    at = r["bucket"]
                keys.append(_parted(r["keys"], True))
                ids.append(_read_ids(r["ids"]))
        yield from flush()

    return lambda batches: _batches(rows(batches), _BLOCK_ARROW)


def _documents(parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            owner = _owner(np.array([i or 0 for i in ids], np.int64), parts)
            for i, text in enumerate(batch.column(1)):
                raw = text.as_py()
                yield {"part": int(owner[i]), "kind": _DOCUMENT, "bucket": 0, "doc_id": ids[i], "ids": None, "keys": None, "text": squeeze.compress((raw or "").encode())}

    return lambda batches: _batches(rows(batches), _BLOCK_ARROW)


def removal(data: bytes, covered: tuple[np.ndarray, np.ndarray], window: int) -> tuple[int, np.ndarray, bytes]:
    """(words, maximal intervals of removed words, kept words joined by a space) of one text, from the keys and checks of its covered windows."""
    buf = np.frombuffer(data, np.uint8)
    starts, ends, _ = C.word_spans(buf, np.array([0, len(buf)]))
    n = len(starts)
    keys, checks = covered
    hit = np.empty(0, bool)
    if len(keys) and n >= window:
        words = C.span_hashes(buf, starts, ends)
        own = window_hashes(words, window)
        hit = np.isin(own, keys)
        # the pair: for one key, sums differ as checks do
        both = lambda k, c: k + (c.astype(np.uint64) << np.uint64(48))
        hit &= np.isin(both(own, window_checks(words, window)), both(keys, checks))
    if not hit.any():
        return n, np.empty((0, 2), np.int64), b" ".join(data.split())
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    change[at] += 1
    change[at + window] -= 1
    gone = np.cumsum(change)[:n] > 0
    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
    words = data.split()
    return n, edges, b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])


def _remove(window: int, with_text: bool):
    """Rows come ordered by part and kind: covered hashes of a part's documents, then the documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, ids, keys, ready = None, [], [], None
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in _each(batch):
                if r["part"] != at:
                    at, ids, keys, ready = r["part"], [], [], None
                if r["kind"] == _COVERED:
                    ids.append(_expand(r["ids"]))
                    keys.append(_parted(r["keys"], False))
                    continue
                if ready is None:
                    d = np.concatenate(ids) if ids else np.empty(0, np.int64)
                    k = np.concatenate([x for x, _ in keys]) if keys else np.empty(0, np.uint64)
                    c = np.concatenate([x for _, x in keys]) if keys else np.empty(0, np.uint16)
                    order = np.argsort(d, kind="stable")
                    ready, ids, keys = (d[order], k[order], c[order]), [], []
                own = np.empty(0, np.uint64), np.empty(0, np.uint16)
                if r["doc_id"] is not None:
                    a, b = np.searchsorted(ready[0], r["doc_id"], "left"), np.searchsorted(ready[0], r["doc_id"], "right")
                    own = ready[1][a:b], ready[2][a:b]
                n, spans, kept = removal(expand.decompress(r["text"]), own, window)
                out = {"doc_id": r["doc_id"], "n_words": n, "n_removed": int((spans[:, 1] - spans[:, 0]).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "intervals": [{"start": int(a), "end": int(b)} for a, b in spans]}
                yield out | ({"text": kept.decode()} if with_text else {})

    schema = _RESULT_ARROW if with_text else _RESULT_ARROW.remove(5)
    return lambda batches: _batches(rows(batches), schema)


def substring_dedup(docs: DataFrame, window: int = 50, *, with_text: bool = False, chunk_windows: int = 1_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, removed words, digest of what is kept, removal intervals [start, end), and with ``with_text`` the kept text.

    chunk_windows: windows of consecutive documents whose repeats a map task joins before the
    shuffle; it bounds a task's memory (about 80 bytes a window) and changes no result.
    """
    tasks = C.shuffle_partitions(docs.sparkSession)
    parts = max(tasks, C.estimated_bytes(docs) // PART_BYTES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = docs.filter("doc_id is not null and text is not null").mapInArrow(_hash_blocks(window, parts, chunk_windows), _BLOCK)
    covered = hashes.repartitionById(parts, "part").sortWithinPartitions("kind", "bucket").mapInArrow(_count_buckets(parts), _BLOCK)
    rows = covered.unionByName(docs.mapInArrow(_documents(parts), _BLOCK))
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_remove(window, with_text), RESULT + ", text string" * with_text)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(C.table(spark, sf_dir, "documents"), 50).drop("intervals")
