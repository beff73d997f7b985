"""Packing token ids into windows of fixed size: best-fit decreasing with a segment tree over remaining capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodespar.llm.common import in_arrow, texts
from lodespar.llm.tokens import ID, encoder, public_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_length long"


class CapacityTree:
    """How many open windows have each remaining capacity 0..size; each node holds the sum of its two children."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        k, count = self.leaves + capacity, self.count
        while k:
            count[k] += change
            k >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open window has; -1 if none has."""
        k, count = self.leaves + need, self.count
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of 1..size tokens, each one's window (from 0) and its offset there."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_at, n = CapacityTree(size), [[] for _ in range(size + 1)], 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        capacity = tree.tightest(need)
        if capacity < 0:
            w, capacity, n = n, size, n + 1
        else:
            w = open_at[capacity].pop()
            tree.add(capacity, -1)
        window[k], offset[k] = w, size - capacity
        if capacity > need:
            open_at[capacity - need].append(w)
            tree.add(capacity - need, 1)
    return window, offset


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 1, pieces_at_once: int = 200_000) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) in windows of at most ``size`` tokens, a row for each piece.

    A document's ids are those of its text and ``end_id``; a null or empty text has ``end_id`` alone. Documents
    longer than ``size`` are first cut into full windows and a rest; rests and short documents are packed by
    best-fit decreasing, ties in arrival order. Each input partition packs its own documents, in batches of
    ``pieces_at_once`` pieces, so nothing is shuffled and memory is bounded; each batch leaves a few windows with
    padding. ``sequence_length`` is the length a sequence is stored with: its tokens if they are a power of two,
    else ``size``. Repeated rows and repeated or null doc_ids are packed like any others; other columns are
    ignored. No rows give no rows. A window's number is the partition's number times 2**32, plus its place."""
    path = tokenizer or public_path()

    def flush(rows: list[tuple], base: int) -> tuple[pa.RecordBatch, int]:
        doc, start, length, crc, total = (np.array(x) if i else list(x) for i, x in enumerate(zip(*rows, strict=True)))
        window, offset = best_fit_decreasing(length, size)
        used = np.bincount(window, weights=length).astype(np.int64)[window]
        padded = np.where(used & (used - 1), size, used)
        columns = [pa.array(doc, pa.int64()), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, total, window + base, offset, used, padded))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")]), base + int(window.max()) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, rows = encoder(path).encode_all, TaskContext.get().partitionId() << 32, []
        end = np.array([end_id], ID).tobytes()
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                ids += end
                total, step = len(ids) // ID.itemsize, size * ID.itemsize
                rows += [(doc, k // ID.itemsize, len(piece := ids[k : k + step]) // ID.itemsize, zlib.crc32(piece), total) for k in range(0, len(ids), step)]
                if len(rows) >= pieces_at_once:
                    out, base = flush(rows, base)
                    rows = []
                    yield out
        if rows:
            yield flush(rows, base)[0]

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").transform(in_arrow, pack, SCHEMA)
