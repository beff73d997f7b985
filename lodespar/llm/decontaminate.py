"""Benchmark decontamination: word n-grams of test items as seeds, a count filter, then Smith-Waterman alignment of what is left."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm.common import cut, in_arrow, quoted

SCHEMA = "doc_id long, item_id long, score double, matched_words long, char_start long, char_end long"
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISMATCH, GAP = 2, -1, -1


def folded(text: str) -> str:
    """``text`` in lower case, character by character: one whose lower case is longer stays, so that places are those of ``text``."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score of the word numbers a and b, and where it ends in b (exclusive); negative numbers match nothing."""
    row, place = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    best, end = 0, 0
    for x in a:
        now = np.maximum(row + GAP, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where((b == x) & (x >= 0), MATCH, MISMATCH))
        row = np.maximum.accumulate(now - GAP * place) + GAP * place
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Score, start and end in b of the best local alignment."""
    score, end = smith_waterman(a, b)
    _, back = smith_waterman(a[::-1], b[:end][::-1])
    return score, end - back, end


@dataclass
class Items:
    """Test items as word numbers, and their n-grams; a bounded part of the benchmark."""

    width: int
    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    hashes: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # of the seeds, ascending
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each seed in ``item`` and ``place``; their length at the end
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bags: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # of each item: its distinct words and how often it has them

    @classmethod
    def of(cls, rows: list[tuple[int, str]], width: int) -> Items:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(folded(text or ""))], np.int64) for _, text in rows]
        kept = [(i, w) for (i, _), w in zip(rows, words, strict=True) if len(w)]
        hashes = np.array([zlib.crc32(w.encode()) | zlib.crc32(w.encode()[::-1] + b"#") << 32 for w in vocabulary], np.uint64)
        return cls(width, [i for i, _ in kept], [w for _, w in kept], vocabulary, hashes)

    def numbers(self, text: str) -> np.ndarray:
        words = _WORD.findall(folded(text))
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the n-grams all of whose words the benchmark has. A shorter item is one n-gram."""
        width = min(self.width, max(1, len(words)))
        known = words >= 0
        ok = np.logical_and.reduce([known[k : len(words) - width + 1 + k] for k in range(width)]) if len(words) else np.zeros(0, bool)
        place = np.flatnonzero(ok)
        key = np.zeros(len(place), np.uint64)
        for k in range(width):
            key = (key ^ self.hashes[words[place + k]]) * _MIX
            key ^= key >> np.uint64(31)
        return place, key

    def choose(self) -> None:
        """Seeds: all n-grams of all items."""
        keys, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, words in enumerate(self.words):
            at, key = self.grams(words)
            keys.append(key)
            items.append(np.full(len(key), n))
            places.append(at)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item, self.place = np.concatenate(items)[order], np.concatenate(places)[order]
        self.bags = [np.unique(x, return_counts=True) for x in self.words]

    def hits(self, key: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``key`` are in the ascending ``among``, and where."""
        if not len(among) or not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(among, key), len(among) - 1)
        yes = np.flatnonzero(among[at] == key)
        return yes, at[yes]

    def matches(self, text: str, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, words matched at most, start, end as words) of each item that the text has a copy of."""
        words = self.numbers(text)
        place, key = self.grams(words)
        yes, at = self.hits(key, self.keys)
        if not len(yes):
            return []
        where = self._candidates(words, np.unique(at), least)
        regions: dict[int, list[list[int]]] = {}
        for p, s in zip(place[yes].tolist(), at.tolist(), strict=True):  # ascending p
            for n, q in where.get(s, ()):
                size = len(self.words[n])
                slack = size // 2 + 2
                a, b = max(0, p - q - slack), min(len(words), p - q + size + slack)
                held = regions.setdefault(n, [])
                if held and a <= held[-1][1] and b - held[-1][0] <= 4 * (size + 2 * slack):
                    held[-1][1] = max(b, held[-1][1])
                else:
                    held.append([a, b])
        found = []
        for n, spans in regions.items():
            item, best = self.words[n], None
            need = np.bincount(item, minlength=len(self.vocabulary)) if len(spans) > 8 else None
            for a, b in spans:
                region = words[a:b]
                shared = self._shared(item, region, need)
                if shared < least * len(item):  # the score can't reach ``least``
                    continue
                score, start, end = aligned(item, region)
                value = score / (MATCH * len(item))
                if value >= least and (best is None or value > best[1]):
                    best = (self.ids[n], value, shared, a + start, a + end)
            if best:
                found.append(best)
        return found

    def _candidates(self, words: np.ndarray, seeds: np.ndarray, least: float) -> dict[int, list[tuple[int, int]]]:
        """Items and places of each of ``seeds``, without items that have too few words in the whole document for a score of ``least``."""
        sizes = self.first[seeds + 1] - self.first[seeds]
        seed = np.repeat(seeds, sizes)
        entry = np.arange(len(seed)) + np.repeat(self.first[seeds] - (np.cumsum(sizes) - sizes), sizes)
        items, of = np.unique(self.item[entry], return_inverse=True)
        times = np.bincount(words[words >= 0], minlength=len(self.vocabulary))
        own = np.concatenate([self.bags[n][0] for n in items])
        most = np.minimum(np.concatenate([self.bags[n][1] for n in items]), times[own])
        starts = np.cumsum([0, *(len(self.bags[n][0]) for n in items[:-1])])
        enough = np.add.reduceat(most, starts) >= least * np.array([len(self.words[n]) for n in items])
        kept = enough[of]
        where: dict[int, list[tuple[int, int]]] = {}
        for s, n, q in zip(seed[kept].tolist(), self.item[entry[kept]].tolist(), self.place[entry[kept]].tolist(), strict=True):
            where.setdefault(s, []).append((n, q))
        return where

    def _shared(self, item: np.ndarray, region: np.ndarray, need: np.ndarray | None) -> int:
        known, times = np.unique(region[region >= 0], return_counts=True)
        if need is not None:
            return int(np.minimum(need[known], times).sum())
        own, count = np.unique(item, return_counts=True)
        _, x, y = np.intersect1d(own, known, assume_unique=True, return_indices=True)
        return int(np.minimum(count[x], times[y]).sum())


def _found(docs: DataFrame, benchmark: DataFrame, width: int, least: float, part_words: int) -> DataFrame:
    """What ``contaminated`` gives, and the document's text_hash."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text")
    own = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null")
    total = own.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    parts, out = max(1, -(-int(total) // part_words)), None
    schema = SCHEMA.replace("doc_id long", "doc_id long, text_hash long")
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        items = Items.of([(x.item_id, x.text) for x in rows], width)
        items.choose()
        chosen = spark.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            items = chosen.value
            for batch in batches:
                found = []
                for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    got = items.matches(text or "", least)
                    if got:
                        spans = [x.span() for x in _WORD.finditer(folded(text))]
                        found += [(doc, key, i, score, n, spans[a][0], spans[b - 1][1]) for i, score, n, a, b in got]
                columns = list(zip(*found, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if k == 3 else pa.int64()) for k, x in enumerate(columns)], names=[x.split()[0] for x in schema.split(", ")])

        got = docs.transform(in_arrow, match, schema)
        out = got if out is None else out.unionByName(got)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 3, least: float = 0.4, part_words: int = 1_000_000) -> DataFrame:
    """A row for each document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it has a copy of.

    Columns: doc_id, item_id, score, matched_words, char_start, char_end (code points of the aligned span). The score
    is the local alignment's (match 2, mismatch -1, gap -1) over that of the whole item; ``least`` and more are copies,
    so that a third of the words may be edited, or half of the item missing. Seeds are all word n-grams of ``width`` words of
    an item, however many documents have them. Before alignment an item goes that shares too few words with the document, or
    with the region about its seeds, to reach ``least``: that bound never drops a copy. The benchmark is broadcast in
    parts of about ``part_words`` words, one scan each, so a hot seed is never shuffled and no broadcast grows.

    Null and empty texts and items without words match nothing; repeated rows give repeated rows; several copies of
    an item in a document are one row, of the best; other columns are ignored; empty tables give no rows."""
    return _found(docs, benchmark, width, least, part_words).drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 3, least: float = 0.4, part_words: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose text has a copy of a test item, whatever other rows share their doc_id; columns as they were."""
    bad = cut(_found(docs, benchmark, width, least, part_words).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    here = docs.select(F.struct(*(quoted(x) for x in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"))
    clean = here.join(bad, (F.col("own_hash") == F.col("bad_hash")) & F.col("own_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return clean.select(*(F.col("row").getField(x).alias(x) for x in docs.columns))
