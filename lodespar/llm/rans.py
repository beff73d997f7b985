"""Token ids in compressed files: a static range asymmetric numeral system over independent interleaved blocks.

A segment holds whole documents in ascending order. All its blocks share one frequency table (sums to
2**16). A block has LANES interleaved 32-bit states and its own stream of 16-bit words, so any block can
be decoded alone: the checkpoint of a block is its final states, the place of its words and the CRC-32
of its ids. Blocks and lanes are coded side by side as numpy arrays.

Segment layout, little-endian: magic ``LRN1``; unsigned 32-bit CRC-32 of all that follows; ten unsigned 64-bit
numbers (documents, ids, symbols, blocks, ids a block, lanes, words, ids before the segment in its
part, part, segment); then arrays: doc_id int64, doc_id-is-null uint8, ids per document uint64; symbol uint32,
frequency uint32; state uint32 (blocks x lanes), words per block uint32, CRC-32 per block uint32; words uint16.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.llm.common import in_arrow, new_folder, texts
from lodespar.llm.tokens import ID, encoder, public_path

MAGIC, HEAD = b"LRN1", struct.Struct("<10Q")
SCALE_BITS, STEPS, LANES = 16, 256, 16
SCALE, BLOCK, LOW = 1 << SCALE_BITS, STEPS * LANES, 1 << 16


class Corrupt(ValueError):
    """A checksum of a segment doesn't match."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive counts scaled to sum to SCALE, each at least 1."""
    if len(counts) > SCALE:
        raise ValueError(f"{len(counts)} symbols don't fit a table of {SCALE}")
    got = np.maximum(1, np.floor(counts * (SCALE / counts.sum()))).astype(np.int64)
    spare = SCALE - int(got.sum())
    if spare > 0:
        got[np.argmax(got)] += spare
    while spare < 0:  # taken from the most frequent, in proportion
        cut = np.minimum(got - 1, np.ceil((got - 1) * (-spare / max(1, int((got - 1).sum())))).astype(np.int64))
        order = np.argsort(-cut, kind="stable")
        cut[order] = np.diff(np.minimum(np.cumsum(cut[order]), -spare), prepend=0)
        got -= cut
        spare += int(cut.sum())
    return got


def _code(index: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols' indices, blocks x STEPS x LANES, as states, words per block, words."""
    start, freq = (np.cumsum(freq) - freq).astype(np.uint32), freq.astype(np.uint32)
    blocks, half = len(index), np.uint32(16)
    state = np.full((blocks, LANES), LOW, np.uint32)
    sent, word = np.zeros((blocks, STEPS, LANES), bool), np.zeros((blocks, STEPS, LANES), np.uint16)
    for t in range(STEPS - 1, -1, -1):
        s = index[:, t]
        f, high = freq[s], state >> half
        sent[:, t] = full = high >= f
        word[:, t] = state  # its low half
        state = np.where(full, high, state)
        q = state // f  # below 2**16 now
        state += (q << half) - q * f + start[s]
    return state, sent.sum((1, 2), dtype=np.uint32), word[sent]


def _decode(state: np.ndarray, sizes: np.ndarray, words: np.ndarray, freq: np.ndarray) -> np.ndarray:
    blocks = len(state)
    start = (np.cumsum(freq) - freq).astype(np.uint32)
    at_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    freq = freq.astype(np.uint32)
    state, place = state.astype(np.uint32), (np.cumsum(sizes, dtype=np.int64) - sizes)
    words = np.append(words, np.uint16(0)).astype(np.uint32)
    out = np.empty((blocks, STEPS, LANES), np.uint32)
    for t in range(STEPS):
        slot = state & np.uint32(SCALE - 1)
        out[:, t] = s = at_slot[slot]
        state = freq[s] * (state >> np.uint32(SCALE_BITS)) + slot - start[s]
        low = state < LOW
        nth = np.cumsum(low, axis=1)
        got = words[np.minimum(place[:, None] + nth - 1, len(words) - 1)]
        state = np.where(low, (state << np.uint32(16)) | got, state)
        place = place + nth[:, -1]
    return out.reshape(-1)


def symbols(ids: np.ndarray, dense: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, ascending; each id's place among them; and their counts. Ids below ``dense`` are counted without a sort."""
    if ids.max(initial=0) >= dense:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbol = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[symbol] = np.arange(len(symbol))
    return symbol, place[ids], counts[symbol]


def encode_segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, before: int = 0, part: int = 0, segment: int = 0) -> bytes:
    symbol, index, counts = symbols(ids)
    if len(ids) == 0:
        symbol, counts, index = np.zeros(1, ID), np.ones(1, np.int64), np.zeros(0, np.int64)
    freq, blocks = frequencies(counts), -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, int(np.argmax(freq)), np.int64)
    padded[: len(ids)] = index
    state, words_of, words = _code(padded.reshape(blocks, STEPS, LANES), freq)
    crc = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype(ID).tobytes()) for k in range(blocks)]
    body = HEAD.pack(len(doc_ids), len(ids), len(symbol), blocks, BLOCK, LANES, len(words), before, part, segment) + b"".join(
        np.asarray(x, kind).tobytes()
        for x, kind in (
            ([x or 0 for x in doc_ids], "<i8"), ([x is None for x in doc_ids], "u1"), (sizes, "<u8"), (symbol, ID), (freq, "<u4"),
            (state, "<u4"), (words_of, "<u4"), (crc, "<u4"), (words, "<u2"),
        )
    )
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def read_segment(data: bytes, only: slice | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """doc_ids, ids per document, the ids, and the ids before the segment in its part. ``only``: of these blocks alone."""
    if data[:4] != MAGIC or zlib.crc32(memoryview(data)[8:]) != struct.unpack_from("<I", data, 4)[0]:
        raise Corrupt("segment")
    docs, n, symbols, blocks, block, lanes, words, before, _, _ = HEAD.unpack_from(data, 8)
    at, found = 8 + HEAD.size, []
    for count, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<u8"), (symbols, ID), (symbols, "<u4"), (blocks * lanes, "<u4"), (blocks, "<u4"), (blocks, "<u4"), (words, "<u2")):
        found.append(np.frombuffer(data, kind, count, at))
        at += found[-1].nbytes
    doc, null, sizes, symbol, freq, state, words_of, crc, words = found
    take = range(blocks)[only or slice(None)]
    first = int(words_of[: take.start].sum())
    ids = symbol[_decode(state.reshape(blocks, lanes)[take.start : take.stop], words_of[take.start : take.stop], words[first:], freq.astype(np.int64))]
    ids = ids[: min(n, take.stop * block) - take.start * block]
    for k in take:
        if zlib.crc32(ids[(k - take.start) * block : (k - take.start + 1) * block].tobytes()) != crc[k]:
            raise Corrupt(f"block {k}")
    return [None if x else int(y) for x, y in zip(null, doc, strict=True)], sizes, ids, before


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, segment_tokens: int = 1 << 21) -> None:
    """The ids of every document of ``docs`` (doc_id, text), in ascending doc_id order, as segments below ``path``.

    Each text's ids are followed by ``end_id``; a null text counts as empty. Order: null doc_ids first, then
    ascending; repeated doc_ids by a hash of the text and then the text, so equal rows only are interchangeable.
    A part is one range of doc_ids. Files are written by Spark's Parquet writer, one segment a row: it commits
    whole files, so a lost executor or a repeated task leaves no partial or double file on any store."""
    tokenizer = tokenizer or public_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode_all, TaskContext.get().partitionId()
        end, before, segment = np.array([end_id], ID).tobytes(), 0, 0
        doc_ids, sizes, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = encode_segment(doc_ids, sizes, np.frombuffer(b"".join(held), ID), before, part, segment)
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((part, pa.int64()), (segment, pa.int64()), (n, pa.int64()), (data, pa.binary()))], names=["part", "segment", "n_tokens", "data"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                held.append(ids + end)
                doc_ids.append(doc)
                sizes.append(len(held[-1]) // ID.itemsize)
                n += sizes[-1]
                if n >= segment_tokens:
                    yield flush()
                    before, segment = before + n, segment + 1
                    doc_ids, sizes, held, n = [], [], [], 0
        if doc_ids:
            yield flush()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    rows.select("doc_id", "text").transform(in_arrow, pack, "part long, segment long, n_tokens long, data binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """From the files below ``path``: doc_id, start (ids before the document), n_tokens, ids_crc32, ids (binary)."""
    files = spark.read.schema("part long, segment long, n_tokens long, data binary").parquet(path)
    # one number for each part, that is for each write task
    parts = sorted((x.part, x.n) for x in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = spark.sparkContext.broadcast(dict(zip((p for p, _ in parts), accumulate((n for _, n in parts), initial=0), strict=False)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                doc_ids, sizes, ids, before = read_segment(data.as_py())
                ends = np.cumsum(sizes).astype(np.int64)
                starts = ends - sizes.astype(np.int64)
                pieces = [ids[a:b].astype(ID).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + (base.value[part] + before)), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(pieces, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return files.select("part", "data").transform(in_arrow, unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, segment_tokens: int = 1 << 21) -> DataFrame:
    """Write ``docs`` to token files and read them back. Without ``path``: in the shared folder. No rows give no rows."""
    path = path or new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id, segment_tokens)
    return read_token_files(docs.sparkSession, path)
