"""MinHash near-dedup: bottom-k sketches from one hash function.

1. Sketch. A scan hashes every document's distinct word shingles with one 64-bit hash. The document's class is a
   digest of the whole set; its sketch is the k smallest hashes, and the few smallest of those are kept beside the
   class for estimates.
2. Frequencies. Sketch values go to the buckets that own them, in packed blocks; a bucket counts
   the classes that hold a value and sends values held by several back to their chunks of documents.
3. Inverted lists. Two sets with Jaccard similarity of at least the threshold share many sketch
   values, so they share one among the rarest few of each (prefix filter). Only those few
   go into inverted lists, keyed by value; exact copies go in once a task.
4. Clusters. In each list the document with the most frequent values (an original rather than
   an edited copy) is the centre. A document and a centre that share a list belong to one cluster; a
   list of m documents thus gives m rows, not m*m pairs.
5. Estimates. A cluster is dealt out in chunks of bounded size, each with its centre, of small sketches only. In a
   chunk, inverted lists of the retained values give overlaps, and union-sketch estimates drop pairs far below
   the threshold. What remains connects documents to candidate groups; most clusters by chance end here, before any
   text or full set has moved.
6. Full sets. Each document of a candidate group goes, with its full set, to one chunk of its group, and the group's
   best-connected document to all of them; overlaps of full sets decide exactly.
7. Across chunks. In a cluster or group of several chunks, documents not yet in the centre's component
   are queries, in blocks, against all chunks of that cluster or group.
8. Components of the confirmed links by minimum-label propagation; every round is a written table.

Links leave a chunk as small stars that connect what they connect, with the centre as a leaf, so no round has a hot key.

Exactness: sets of up to ``ESTIMATE`` shingles lose no link. Larger sets lose one only if two sketches share
fewer values than expected by ``slack`` standard deviations (5: binomial tails of about one in a million for a pair just
at the threshold, less above it). Links are confirmed on full sets of 64-bit hashes.

Defined results: null or empty text has no shingles and is linked with nothing; a text with fewer
words than a shingle is one shingle; equal sets are linked; rows with the same doc_id are one
document (linked); a null doc_id is linked with nothing, has a null component and is kept; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Values kept in a sketch, and of them for estimates; standard deviations of slack.
SKETCH, ESTIMATE, SLACK = 128, 48, 5.0
#: Parts that a hot class or component is dealt into where its label is joined, and entries of a hot list a part.
SALTS, LIST_ROWS = 16, 512
#: Documents and shingles that one chunk of a cluster holds at most (one document may hold more).
CHUNK_DOCS, CHUNK_SHINGLES = 768, 400_000


def shingle_sets(data: bytes, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text in ``data``; A-Z are lower-cased."""
    buf = np.frombuffer(data.translate(C.LOWER_AZ), np.uint8)
    starts, ends, at = C.word_spans(buf, offsets)
    words = C.span_hashes(buf, starts, ends)
    out = []
    for i in range(len(at) - 1):
        own = words[at[i] : at[i + 1]]
        n = len(own)
        with np.errstate(over="ignore"):
            if not n:
                h = own
            else:
                m = min(size, n)
                h = own[: n - m + 1].copy()
                for j in range(1, m):
                    h = C.mix(h * np.uint64(C.BASES[1])) + own[j : n - m + 1 + j]
                h = np.unique(C.mix(h + np.uint64(m)))
        out.append(h)
    return out


def class_digest(h: np.ndarray) -> int:
    """A digest of a whole set: a sum of its mixed members, so the order doesn't matter."""
    with np.errstate(over="ignore"):
        total = C.mix(h ^ np.uint64(C.BASES[0])).sum(dtype=np.uint64) + np.uint64(len(h)) * np.uint64(C.WINDOW_BASE)
    return int(C.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, _end, data, offsets in C.text_groups(batch):
            for i, h in enumerate(shingle_sets(data, offsets, size)):
                yield ids[first + i], h


def _rows(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if len(held) >= most or size >= most_bytes:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


_DOC = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])
#: Classes that a task remembers; when there are more, it starts anew, and copies far apart are sent again.
REMEMBERED = 1 << 20


class _Seen:
    """Whether a class was met lately in this task."""

    def __init__(self):
        self.known = set()

    def __call__(self, node: int) -> bool:
        if node in self.known:
            return True
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known.add(node)
        return False


def _classes(size: int, few: int):
    def rows(batches):
        seen = _Seen()
        for doc_id, h in _sets(batches, size):
            node = class_digest(h) if len(h) else None
            yield doc_id, len(h), node, None if node is None or doc_id is None or seen(node) else h[:few].tobytes()

    return lambda batches: _rows(rows(batches), _DOC)


def prefix_length(n: int, k: int, threshold: float, slack: float) -> int:
    """How many of a set's rarest sketch values to index, so that two sets at the threshold share one of them."""
    need = -(-round(threshold * n * 10**6) // 10**6)  # the larger of two such sets shares that many, if both are whole
    if n > threshold * k:  # a partner's sketch may be cut off, or this one
        need = min(need, int(k * threshold - slack * (k * threshold * (1 - threshold)) ** 0.5))
    return min(n, k) - max(need, 1) + 1


_BLOCK = "part int, kind int, chunk long, values binary, locals binary, counts binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("values", pa.binary()), ("locals", pa.binary()), ("counts", pa.binary())])
#: kinds of rows: a chunk's classes, frequent values sent back to a chunk, values for a bucket.
_CLASSES, _FREQUENT, _VALUES = 0, 1, 2
#: Sketch values that one chunk holds; its classes have 16-bit numbers. Lists are keyed by 48 bits
#: of a value: two values that agree in them put a document in a needless list, no more.
CHUNK_VALUES = 1_000_000
#: Sketch values that one bucket holds at most, about.
BUCKET_VALUES = 1 << 22


def _owner(chunk: int, parts: int) -> int:
    return int(C.mix(np.array([chunk], np.int64).view(np.uint64))[0] % np.uint64(parts))


def _sketches(size: int, k: int, parts: int):
    """Each chunk's sketch values, in blocks for the buckets that own them, and its list of classes; copies in one task count once."""

    def rows(batches):
        task, number, seen = TaskContext.get().partitionId(), 0, _Seen()
        nodes, sizes, sketches, held = [], [], [], 0

        def flush():
            chunk = task << 32 | number
            lengths = [len(x) for x in sketches]
            values, local = np.concatenate(sketches) >> np.uint64(16), np.repeat(np.arange(len(sketches), dtype=np.uint16), lengths)
            order = np.argsort(values, kind="stable")
            values, local = values[order], local[order]
            yield _owner(chunk, parts), _CLASSES, chunk, np.array(nodes, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), None
            bucket = (values & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)  # a sketch holds low values, so not by their high bits
            order = np.argsort(bucket, kind="stable")
            values, local, bucket = values[order], local[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64))
            for b in range(parts):
                if edges[b] < edges[b + 1]:
                    own = slice(edges[b], edges[b + 1])
                    yield b, _VALUES, chunk, C.pack(values[own]), local[own].tobytes(), None

        for _doc, h in _sets(batches, size):
            if not len(h) or seen(node := class_digest(h)):
                continue
            nodes.append(node)
            sizes.append(len(h))
            sketches.append(h[:k].copy())
            held += len(sketches[-1])
            if held >= CHUNK_VALUES or len(nodes) == 1 << 16:
                yield from flush()
                nodes, sizes, sketches, held, number = [], [], [], 0, number + 1
        if held:
            yield from flush()

    return lambda batches: _rows(rows(batches), _BLOCK_ARROW)


def _frequencies(parts: int):
    """Values that several classes hold go back to their chunks, with the number of classes. Rows come ordered by kind and part."""

    def rows(batches):
        at, held = None, []

        def flush():
            values = np.concatenate([C.unpack(v) for _, v, _ in held])
            local = np.concatenate([np.frombuffer(x, np.uint16) for _, _, x in held])
            chunk = np.repeat([c for c, _, _ in held], [len(x) // 2 for _, _, x in held])
            order = np.argsort(values, kind="stable")
            values, local, chunk = values[order], local[order], chunk[order]
            edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
            count = np.repeat(np.diff(edges), np.diff(edges))
            keep = count > 1
            values, local, chunk, count = values[keep], local[keep], chunk[keep], count[keep].clip(max=(1 << 32) - 1).astype("<u4")
            order = np.argsort(chunk, kind="stable")
            values, local, chunk, count = values[order], local[order], chunk[order], count[order]
            edges = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                c = int(chunk[a])
                yield _owner(c, parts), _FREQUENT, c, C.pack(values[a:b]), local[a:b].tobytes(), count[a:b].tobytes()

        for batch in batches:
            for part, kind, chunk, values, local, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _CLASSES:
                    yield part, kind, chunk, values, local, counts
                    continue
                if part != at:
                    if held:
                        yield from flush()
                    at, held = part, []
                held.append((chunk, values, local))
        if held:
            yield from flush()

    return lambda batches: _rows(rows(batches), _BLOCK_ARROW)


_ENTRY = pa.schema([("value", pa.int64()), ("node", pa.int64()), ("score", pa.int32()), ("salts", pa.int32())])


def _entries(k: int, threshold: float, slack: float):
    """The rarest values of each class, of those that others hold too. Rows come ordered by chunk and kind."""

    def rows(batches):
        at, nodes, sizes, held = None, None, None, []

        def flush():
            if not held:
                return None
            values = np.concatenate([C.unpack(v) for v, _, _ in held])
            local = np.concatenate([np.frombuffer(x, np.uint16) for _, x, _ in held]).astype(np.int64)
            count = np.concatenate([np.frombuffer(x, "<u4") for _, _, x in held])
            order = np.lexsort((values, count, local))
            values, local, count = values[order], local[order], count[order]
            many = np.bincount(local, minlength=len(nodes))
            kept = np.minimum(sizes, k)
            score = (1000 * np.bincount(local, np.log2(count), len(nodes)) / kept).astype(np.int32)
            own = np.array([prefix_length(int(n), k, threshold, slack) for n in sizes]) - (kept - many)
            rank = np.arange(len(local)) - (np.cumsum(many) - many)[local]
            keep = rank < own[local]
            if not keep.any():
                return None
            local = local[keep]
            salts = (1 + count[keep] // LIST_ROWS).clip(max=1 << 16).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(nodes[local]), pa.array(score[local]), pa.array(salts)], schema=_ENTRY)

        for batch in batches:
            for _part, kind, chunk, values, local, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == _CLASSES:
                    if (out := flush()) is not None:
                        yield out
                    at, nodes, sizes, held = chunk, np.frombuffer(values, "<i8"), np.frombuffer(local, "<i8"), []
                else:
                    assert chunk == at, "a chunk's classes come before its values"
                    held.append((values, local, counts))
        if (out := flush()) is not None:
            yield out

    return rows


def list_entries(docs: DataFrame, shingle: int, threshold: float, k: int, slack: float, buckets: int) -> DataFrame:
    """(value, node, score, salts): the inverted lists of the rarest sketch values that at least two classes hold, and into how many parts a list is dealt."""
    tasks = C.shuffle_partitions(docs.sparkSession)
    blocks = docs.mapInArrow(_sketches(shingle, k, buckets), _BLOCK)
    back = blocks.repartitionById(tasks, "part").sortWithinPartitions("kind", "part").mapInArrow(_frequencies(buckets), _BLOCK)
    return back.repartitionById(tasks, "part").sortWithinPartitions("chunk", "kind").mapInArrow(_entries(k, threshold, slack), "value long, node long, score int, salts int")


_SET = pa.schema([("centre", pa.int64()), ("chunk", pa.int64()), ("hot", pa.bool_()), ("node", pa.int64()), ("hashes", pa.binary())])


def _full_sets(size: int):
    """Rows (text, centre, chunk, hot, node): the full set of each text that is of the class ``node``."""

    def rows(batches):
        for batch in batches:
            centre, chunk, hot, nodes = (batch.column(i).to_pylist() for i in range(1, 5))
            for first, _end, data, offsets in C.text_groups(batch):
                for i, h in enumerate(shingle_sets(data, offsets, size), first):
                    if len(h) and class_digest(h) == nodes[i]:
                        yield centre[i], chunk[i], hot[i], nodes[i], h.tobytes()

    return lambda batches: _rows(rows(batches), _SET)


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, from the inverted lists of their values. If both are one list, only pairs of different places count."""
    a, b = np.concatenate(rows), np.concatenate(cols)
    owner_a = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    owner_b = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    if rows is cols:
        shared, often = np.unique(a, return_counts=True)
        shared = shared[often > 1]
    else:
        shared = np.intersect1d(a, b)
    out = np.zeros((len(rows), len(cols)), np.float32)
    step = max(256, (1 << 20) // max(len(rows), len(cols)))
    col_a, col_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ok_a = (col_a < len(shared)) & (shared[np.minimum(col_a, len(shared) - 1)] == a) if len(shared) else np.zeros(len(a), bool)
    ok_b = (col_b < len(shared)) & (shared[np.minimum(col_b, len(shared) - 1)] == b) if len(shared) else np.zeros(len(b), bool)
    owner_a, col_a, owner_b, col_b = owner_a[ok_a], col_a[ok_a], owner_b[ok_b], col_b[ok_b]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    owner_a, col_a, owner_b, col_b = owner_a[order_a], col_a[order_a], owner_b[order_b], col_b[order_b]
    for at in range(0, len(shared), step):
        x, y = np.zeros((len(rows), step), np.float32), np.zeros((len(cols), step), np.float32)
        i, j = np.searchsorted(col_a, [at, at + step])
        x[owner_a[i:j], col_a[i:j] - at] = 1
        i, j = np.searchsorted(col_b, [at, at + step])
        y[owner_b[i:j], col_b[i:j] - at] = 1
        out += x @ y.T
    return out


def likely(rows: list[np.ndarray], cols: list[np.ndarray], k: int, threshold: float, slack: float) -> np.ndarray:
    """Which pairs may reach the threshold, from their k smallest values: sketch overlaps and union-sketch estimates."""
    sk_r = [x[:k] for x in rows]
    sk_c = sk_r if rows is cols else [x[:k] for x in cols]
    top = np.uint64((1 << 64) - 1)
    cut_r = np.array([x[-1] if len(x) == k else top for x in sk_r], np.uint64)
    cut_c = np.array([x[-1] if len(x) == k else top for x in sk_c], np.uint64)
    common = overlaps(sk_r, sk_c)
    cut = np.minimum.outer(cut_r, cut_c)
    below_r = np.stack([np.searchsorted(x, c, "right") for x, c in zip(sk_r, cut, strict=True)])
    below_c = np.stack([np.searchsorted(x, c, "right") for x, c in zip(sk_c, cut.T, strict=True)]).T
    union = np.maximum(below_r + below_c - common, 1)
    spread = np.where(cut == top, 0, slack * np.sqrt(threshold * (1 - threshold) / union))
    return common / union >= threshold - spread - 1e-6


def linked(rows: list[np.ndarray], cols: list[np.ndarray], k: int, threshold: float, slack: float) -> np.ndarray:
    """Which pairs of full sets reach the threshold: sizes and estimates first, then exact overlaps where these leave it open.

    If ``rows`` and ``cols`` are one list, only pairs of different places count.
    """
    size_r, size_c = np.array([len(x) for x in rows]), np.array([len(x) for x in cols])
    percent = round(threshold * 100)
    hit = 100 * np.minimum.outer(size_r, size_c) >= percent * np.maximum.outer(size_r, size_c)
    if not hit.any():
        return hit
    hit &= likely(rows, cols, k, threshold, slack)
    if rows is cols:
        np.fill_diagonal(hit, False)
    keep_r, keep_c = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(keep_r):
        return hit
    own = [rows[i] for i in keep_r]
    both = overlaps(own, own if rows is cols else [cols[j] for j in keep_c]).astype(np.int64)
    union = np.add.outer(size_r[keep_r], size_c[keep_c]) - both
    exact = np.zeros_like(hit)
    exact[np.ix_(keep_r, keep_c)] = 100 * both >= percent * union
    return hit & exact


_LINK = pa.schema([("centre", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_LINKS = "centre long, a long, b long"


def _joint(links: np.ndarray) -> np.ndarray:
    """A label for each place: places that ``links`` connect share one."""
    label = np.arange(len(links))
    for i, j in zip(*np.nonzero(np.triu(links, 1)), strict=True):
        if (x := label[i]) != (y := label[j]):
            label[label == y] = x
    return label


def _spanning(label: np.ndarray, names: list[int], centre: int) -> Iterator[tuple[int, int]]:
    """Stars that connect names of one label, around the smallest one but the centre: the centre is in all chunks and must stay a leaf."""
    order = np.argsort(label, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        own = sorted((names[i] == centre, names[i]) for i in own)
        for _, name in own[1:]:
            yield own[0][1], name


#: Rows of an Arrow batch that become Python values at a time.
SLICE_ROWS = 256


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns."""
    at, held = None, []
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            for r in zip(*(c.to_pylist() for c in batch.slice(first, SLICE_ROWS).columns), strict=True):
                if r[:keys] != at:
                    if held:
                        yield at, held
                    at, held = r[:keys], []
                held.append(r[keys:])
    if held:
        yield at, held


def _pieces(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Runs of sets that fit in memory together."""
    out, first, size = [], 0, 0
    for i, s in enumerate(sets):
        if i > first and size + len(s) > CHUNK_SHINGLES:
            out.append((first, i))
            first, size = i, 0
        size += len(s)
    return [*out, (first, len(sets))]


def _within(test, k: int, threshold: float, slack: float):
    """Rows (centre, chunk, hot, node, hashes): links inside each chunk, by ``test``; in hot clusters also, without a partner, the nodes that nothing in their chunk connects with the centre."""

    def rows(batches):
        for (centre, _chunk, hot), held in _groups(batches, 3):
            held = sorted({n: h for n, h in held}.items())
            names, sets = [n for n, _ in held], [np.frombuffer(h, np.uint64) for _, h in held]
            pieces = _pieces(sets)
            hit = np.zeros((len(names), len(names)), bool)
            for i, (a, b) in enumerate(pieces):
                own = sets[a:b]
                for c, d in pieces[i:]:
                    hit[a:b, c:d] = test(own, own if c == a else sets[c:d], k, threshold, slack)
            label = _joint(hit)
            for a, b in _spanning(label, names, centre):
                yield centre, a, b
            if hot:
                main = label[names.index(centre)] if centre in names else -1
                for name, lab in zip(names, label.tolist(), strict=True):
                    if lab != main:
                        yield centre, name, None

    return lambda batches: _rows(rows(batches), _LINK)


def _across(test, k: int, threshold: float, slack: float):
    """Rows (centre, chunk, block, query, node, hashes), queries first: links between a block of queries and a chunk, enough of them to connect what they connect."""

    def rows(batches):
        for (centre, *_), held in _groups(batches, 3):
            asks = [(n, np.frombuffer(h, np.uint64)) for q, n, h in held if q]
            rest = [(n, np.frombuffer(h, np.uint64)) for q, n, h in held if not q]
            if not asks or not rest:
                continue
            sets_q, sets_r = [x[1] for x in asks], [x[1] for x in rest]
            hit = np.zeros((len(asks), len(rest)), bool)
            for a, b in _pieces(sets_q):
                for c, d in _pieces(sets_r):
                    hit[a:b, c:d] = test(sets_q[a:b], sets_r[c:d], k, threshold, slack)
            names = [x[0] for x in (*asks, *rest)]
            both = np.zeros((len(names), len(names)), bool)
            both[: len(asks), len(asks) :] = hit
            for a, b in _spanning(_joint(both), names, centre):
                if a != b:
                    yield centre, a, b

    return lambda batches: _rows(rows(batches), _LINK)


#: Rounds of label propagation before shortcuts are taken as well.
PLAIN_ROUNDS = 3


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that ``links`` (a, b) reach from each node, by label propagation.

    Labels only ever fall, so the rounds end. Most components settle in a few; for the chains of others each further round also
    takes the label of one's label, which halves what is left. Nodes of one component share a label, so that join is salted.
    """
    edges = C.stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = C.stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    done = 0
    while True:
        near = edges.join(labels.withColumnsRenamed({"node": "b", "label": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        nxt = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        if done >= PLAIN_ROUNDS:
            far = labels.filter("label < node").select(F.col("node").alias("new"), F.col("label").alias("far"), _every_salt().alias("salt"))
            nxt = _salt(nxt).join(far, ["new", "salt"], "left").select("node", "label", F.coalesce("far", "new").alias("new"))
        nxt = C.stored(nxt, "labels")
        moved = nxt.filter("label <> new").limit(1).count()
        C.release(labels)
        labels = C.renewed(nxt.select("node", F.col("new").alias("label")), nxt)
        done += 1
        if not moved:
            C.release(edges)
            return labels


def _salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))


#: Rows of one key that a join deals over salts.
HOT_ROWS = 4096


def _beside(rows: DataFrame, side: DataFrame, key: str, weight: str, own: str, extra: list[str]) -> DataFrame:
    """``rows`` (with a salt) left-joined with ``side``, a row a key: columns ``extra``, null where there is none.

    A key may hold a third of all rows. ``weight`` of ``side`` says how many it holds: the few heavy keys are joined first, over salts,
    and their rows then leave the plain join by a key from their column ``own`` that meets nothing (if it did, the first result would hold).
    """
    heavy = side.filter(F.col(weight) > HOT_ROWS).select(key, _every_salt().alias("salt"), F.lit(True).alias("__heavy"), *[F.col(c).alias(f"__{c}") for c in extra])
    light = side.filter(F.col(weight) <= HOT_ROWS).select(F.col(key).alias("__key"), *extra)
    rows = rows.join(heavy, [key, "salt"], "left").withColumn("__key", F.when(F.col("__heavy"), F.xxhash64(own, F.lit(1))).otherwise(F.col(key)))
    kept = [c for c in rows.columns if not c.startswith("__") and c != "salt"]
    return rows.join(light, "__key", "left").select(*kept, *[F.when(F.col("__heavy"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in extra])


def _stars(entries: DataFrame) -> DataFrame:
    """(centre, node): each list's best-connected document with every other one of it."""
    best = entries.groupBy("value").agg(F.max(F.struct("score", "node")).alias("top"), F.min("node").alias("low"), F.max("node").alias("high"), F.max("salts").alias("salts")).filter("low <> high")
    best = best.select("value", F.col("top.node").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    return dealt.join(best, ["value", "salt"]).filter("node <> centre").select("centre", "node").distinct()


def _inside(rows: DataFrame, test, k: int, threshold: float, slack: float) -> DataFrame:
    """Links inside the chunks of rows (centre, chunk, hot, node, hashes), as ``_within`` gives them."""
    tasks = C.shuffle_partitions(rows.sparkSession)
    rows = rows.select("centre", "chunk", "hot", "node", "hashes").repartition(tasks, "centre", "chunk").sortWithinPartitions("centre", "chunk")
    return rows.mapInArrow(_within(test, k, threshold, slack), _LINKS)


def _between(many: DataFrame, placed: DataFrame, sets: DataFrame, links: DataFrame, test, k: int, threshold: float, slack: float) -> DataFrame:
    """Links between chunks of one cluster: nodes that their chunk doesn't connect with the centre, in blocks, against all chunks.

    ``many`` (centre, chunks), ``placed`` (centre, chunk, node), ``sets`` (node, hashes).
    """
    asks = links.filter("b is null").select("centre", F.col("a").alias("node")).distinct()
    many = asks.groupBy("centre").agg(F.ceil(F.count("*") / CHUNK_DOCS).alias("blocks")).join(many, "centre")
    many = C.stored(many, "blocks")  # a row a hot cluster
    if not many.limit(1).count():
        return links
    spread = many.withColumn("salt", _every_salt())
    asks = _salt(asks).join(spread, ["centre", "salt"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    left = asks.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", F.lit(1).alias("query"), "node")
    right = _salt(placed).join(spread, ["centre", "salt"]).select("centre", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("query"), "node")
    rows = left.unionByName(right).join(sets, "node").select("centre", "chunk", "block", "query", "node", "hashes")
    tasks = C.shuffle_partitions(rows.sparkSession)
    rows = rows.repartition(tasks, "centre", "chunk", "block").sortWithinPartitions("centre", "chunk", "block", F.desc("query"))
    return links.union(C.stored(rows.mapInArrow(_across(test, k, threshold, slack), _LINKS), "links"))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, k: int = SKETCH, slack: float = SLACK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = C.stored(docs.mapInArrow(_classes(shingle, ESTIMATE), "doc_id long, n_shingles long, node long, sketch binary"), "classes")
    named = members.filter("node is not null and doc_id is not null")
    with C.scratch() as keep:
        links = _links(docs.filter("doc_id is not null"), named, shingle, threshold, k, slack)
        # one document with several texts links their classes
        twice = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("doc_id", "a")
        same = named.join(twice, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
        label = components(links.select("a", "b").union(same))
        keep.append(label)
    # the label of a component is its smallest doc_id; hot classes are dealt over salts
    classes = named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs")).join(label, "node", "left")
    classes = classes.filter("docs > 1 or label is not null").select("node", "least", "docs", F.coalesce("label", "node").alias("label"))
    roots = classes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    return _labelled(members, _beside(_salt(classes), roots, "label", "classes", "node", ["component_id"]))


def _links(docs: DataFrame, named: DataFrame, shingle: int, threshold: float, k: int, slack: float) -> DataFrame:
    """(a, b): enough confirmed links between classes to connect what all links connect."""
    values = named.agg(F.sum(F.least("n_shingles", F.lit(k)))).first()[0] or 0
    buckets = max(C.shuffle_partitions(docs.sparkSession), -(-values // BUCKET_VALUES))
    entries = C.stored(list_entries(docs, shingle, threshold, k, slack, buckets), "entries")
    stars = C.stored(_stars(entries), "stars")
    C.release(entries)

    # clusters in chunks, each with its centre; sketches only
    sized = C.stored(stars.groupBy("centre").agg(F.count("*").alias("n")), "sizes")
    many = sized.filter(F.col("n") > CHUNK_DOCS).select("centre", F.ceil(F.col("n") / CHUNK_DOCS).alias("chunks"))
    placed = _salt(stars).join(many.withColumn("salt", _every_salt()), ["centre", "salt"], "left")
    placed = placed.select("centre", F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0)).alias("chunk"), F.col("chunks").isNotNull().alias("hot"), "node")
    hubs = sized.select("centre", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK_DOCS) - 1)).alias("chunk"), F.col("n") > CHUNK_DOCS, F.col("centre").alias("node"))
    placed = C.stored(placed.union(hubs), "placed")
    few = named.filter("sketch is not null").select("node", F.col("sketch").alias("hashes")).join(placed.select("node").distinct(), "node").dropDuplicates(["node"])
    few = C.stored(few, "sketches")
    maybe = C.stored(_inside(placed.join(few, "node"), likely, ESTIMATE, threshold, slack), "maybe")
    if many.limit(1).count():
        maybe = _between(many, placed, few, maybe, likely, ESTIMATE, threshold, slack)
    group = components(maybe.filter("b is not null"))
    C.release(stars, placed, few)

    # candidate groups in chunks bounded in documents and shingles, each with the group's hub; full sets
    own = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")).join(group, "node")
    own = C.stored(own.join(sized.select(F.col("centre").alias("node"), F.col("n").alias("stars")), "node", "left"), "groups")
    groups = own.groupBy("label").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.max(F.struct("stars", "node", "doc_id")).alias("hub"))
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES))
    hot = C.stored(groups.select("label", chunks.alias("chunks"), F.col("hub.node").alias("centre"), F.col("hub.doc_id").alias("doc_id")).filter("chunks > 1"), "hubs")
    placed = _salt(own).join(hot.select("label", "chunks", "centre", _every_salt().alias("salt")), ["label", "salt"], "left")
    placed = placed.select("doc_id", F.coalesce("centre", "label").alias("centre"), F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0)).alias("chunk"), F.col("chunks").isNotNull().alias("hot"), "node")
    placed = placed.union(hot.select("doc_id", "centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), F.lit(True), F.col("centre")))
    sets = docs.join(placed, "doc_id").select("text", "centre", "chunk", "hot", "node").mapInArrow(_full_sets(shingle), "centre long, chunk long, hot boolean, node long, hashes binary")
    if not hot.limit(1).count():
        return C.stored(_inside(sets, linked, ESTIMATE, threshold, slack), "links")
    sets = C.stored(sets, "sets")
    links = C.stored(_inside(sets, linked, ESTIMATE, threshold, slack), "links")
    full = sets.filter("hot").select("node", "hashes").dropDuplicates(["node"])
    return _between(hot.select("centre", "chunks"), placed.filter("hot").select("centre", "chunk", "node"), full, links, linked, ESTIMATE, threshold, slack).filter("b is not null")


def _every_salt():
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def _labelled(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents with their classes' components. Documents whose class has no row are alone; those without id have no component."""
    rows = members.drop("sketch").filter("doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = _beside(rows, classes.select("node", "docs", "component_id"), "node", "docs", "doc_id", ["component_id"])
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.union(members.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its component; of repeated rows with one doc_id, all with the kept id stay."""
    lost = near_duplicates(docs, shingle, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["__lost"], "left_anti")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), shingle=2)
