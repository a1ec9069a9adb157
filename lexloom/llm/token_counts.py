"""Token counts: batch encoding in Arrow functions that return lengths only.

A byte-level tokenizer never joins a token across the place where white space follows something that
is not white space, so a text's count is the sum of its pieces' counts between such places. Long texts are
thereby split at safe boundaries, and since most pieces occur again and again, each task encodes a distinct piece
once and looks its length up afterwards. Pieces to encode go to the library in batches balanced by
bytes. The table of lengths is bounded; when it is full, it starts anew.

Places where the byte before is part of a character that might be Unicode white space are no boundaries. Special
strings hold no white space, so none is cut, and the library treats them in a piece as in the text; a tokenizer with an added
token that holds white space, or one of another kind, encodes whole texts. A text without white space is one piece.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows are kept as they are, whatever their doc_id; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Piece lengths a task remembers, bytes of pieces encoded at a time.
REMEMBERED, BATCH_BYTES = 1_500_000, 1 << 18

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def boundaries(buf: np.ndarray) -> np.ndarray:
    """Positions before ASCII white space that surely follows something else."""
    if len(buf) < 2:
        return np.empty(0, np.int64)
    white = C._WHITE[buf]
    before = buf[:-1]
    sure = (before < 128) & ~white[:-1] & ((before < 0x1C) | (before > 0x1F))
    lead = np.zeros(len(buf) - 1, bool)  # of two-byte characters above U+00BF: letters mostly, never white space
    lead[1:] = (before[1:] >= 128) & (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xDF)
    return np.flatnonzero(white[1:] & (sure | lead)) + 1


class Lengths:
    """Token counts of pieces by hash, in sorted arrays."""

    def __init__(self, count):
        self.count, self.keys, self.values = count, np.empty(0, np.uint64), np.empty(0, np.int32)

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = C.span_hashes(buf, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        out = np.zeros(len(distinct), np.int32)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            a, b = starts[first[new]], ends[first[new]]
            out[new] = self.count([raw[i:j].decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)], (b - a).tolist())
            if len(self.keys) + len(new) > REMEMBERED:
                self.keys, self.values = np.empty(0, np.uint64), np.empty(0, np.int32)
            keys, values = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.values, out[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], values[order]
        return out[back]


def _balanced(pieces: list[str], sizes: list[int] | None) -> Iterator[list[str]]:
    """Batches of about ``BATCH_BYTES`` each; ``sizes`` are the pieces' bytes."""
    held, size = [], 0
    for p, n in zip(pieces, sizes or [len(p.encode()) for p in pieces], strict=True):
        held.append(p)
        size += n
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def load_counter(path: str):
    """A function from texts (and their bytes, if known) to token counts, for a .json (tokenizers) or .model (sentencepiece) file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts, sizes=None: [len(x) for batch in _balanced(texts, sizes) for x in model.encode(batch, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts, sizes=None: [len(x) for batch in _balanced(texts, sizes) for x in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


_LOADED: dict[str, Lengths] = {}


def _counts(path: str, split: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:  # once a worker
            _LOADED[path] = Lengths(load_counter(path))
        lengths = _LOADED[path]
        for batch in batches:
            ids, sizes, tokens = batch.column(0), [], []
            for first, end, data, offsets in C.text_groups(batch):
                sizes.append(np.diff(offsets))
                if not split:
                    tokens.append(np.array(lengths.count([data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]), np.int64))
                    continue
                buf = np.frombuffer(data, np.uint8)
                starts = np.unique(np.concatenate([boundaries(buf), offsets[:-1][np.diff(offsets) > 0]]))
                n = np.zeros(end - first, np.int64)
                if len(starts):
                    each = lengths.of(buf, starts, np.append(starts[1:], len(buf)))
                    total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                    cut = np.searchsorted(starts, offsets)
                    n = total[cut[1:]] - total[cut[:-1]]
                tokens.append(n)
            if tokens:
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(tokens), pa.int64())], schema=_OUT)

    return rows


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit. Pieces are used for byte-level BPE without a normaliser; other kinds encode whole texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(path, _splits(path)), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def _splits(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    before = kind.get("pre_tokenizer") or {}
    plain = not any(a.get(k) for a in kind.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")) and not any(any(c.isspace() for c in a.get("content", "")) for a in kind.get("added_tokens", []))
    return plain and not kind.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
