"""Language identification by bit-sliced Bloom filters: one lookup gives the mask of all languages that contain an n-gram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodespar.llm.common import cut, held_out, in_arrow, texts, unit_hash

UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, margin double"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_letters: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """The lower-cased text's code points, each run of others as one 0, with a 0 at both ends; empty without letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate((np.zeros(1, np.uint32), np.where(_letters[codes], codes, np.uint32(0)), np.zeros(1, np.uint32)))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return codes if len(codes) > 1 else codes[:0]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n code points that isn't only word ends."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    codes = codes.astype(np.uint64)
    size = len(codes) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + size]) * _MIX[0]
        h ^= h >> np.uint64(29)
    return h


@dataclass
class LanguageFilters:
    """Row r of a table has bit l set if a kept n-gram of its language l hashes to that row; a table serves 64 languages."""

    languages: list[str]
    sizes: tuple[int, ...]
    tables: list[np.ndarray]
    hashes: int
    false_rate: np.ndarray
    coverage: np.ndarray

    @classmethod
    def of(cls, languages: list[str], sizes: tuple[int, ...], tables: list[np.ndarray], coverage: list[float], hashes: int = 3) -> LanguageFilters:
        """From filled tables; how full they are gives the false positives."""
        fill = [np.count_nonzero(tables[l // 64] & tables[l // 64].dtype.type(1 << l % 64)) / len(tables[l // 64]) for l in range(len(languages))]
        return cls(languages, sizes, tables, hashes, np.array(fill) ** hashes, np.array(coverage))

    @classmethod
    def build(cls, languages: list[str], sizes: tuple[int, ...], kept: list[tuple[np.ndarray, float]], hashes: int = 3) -> LanguageFilters:
        """``kept``: for each language its n-grams' hashes and what share of its text they cover."""
        tables = cls.empty([len(x) for x, _ in kept])
        for l, (found, _) in enumerate(kept):
            table = tables[l // 64]
            for k in range(hashes):
                table[cls.rows_of(found, k, len(table))] |= table.dtype.type(1 << l % 64)
        return cls.of(languages, sizes, tables, [x for _, x in kept], hashes)

    @staticmethod
    def empty(counts: list[int], room: int = 12) -> list[np.ndarray]:
        """Tables for languages with so many n-grams each; ``room``: rows for each n-gram of the one that has most."""
        parts = [counts[s : s + 64] for s in range(0, len(counts), 64)]
        return [np.zeros(1 << max(10, int(room * max(1, *own, 1) - 1).bit_length()), np.uint8 if len(own) <= 8 else np.uint64) for own in parts]

    @staticmethod
    def rows_of(found: np.ndarray, k: int, rows: int) -> np.ndarray:
        return ((found * _MIX[k % 3] + np.uint64(k)) >> np.uint64(64 - (rows - 1).bit_length())).astype(np.int64)

    def _hits(self, found: np.ndarray) -> list[int]:
        """For each language, how many of ``found`` its filter has: the popcount of its bit over all masks."""
        out = []
        for s, table in enumerate(self.tables):
            mask = table[self.rows_of(found, 0, len(table))]
            for k in range(1, self.hashes):
                mask = mask & table[self.rows_of(found, k, len(table))]
            own = range(min(64, len(self.languages) - 64 * s))
            if mask.dtype == np.uint8:
                by_mask = np.bincount(mask, minlength=256)
                out += [int(by_mask[(np.arange(256) >> l) & 1 == 1].sum()) for l in own]
            else:
                out += [np.count_nonzero(mask & np.uint64(1 << l)) for l in own]
        return out

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, its evidence (1: as many known n-grams as its own text has), and the lead over the next one."""
        codes = letters(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        total, hits = 0, np.zeros(len(self.languages))
        for a in range(0, len(codes), 1 << 20):  # bounds what a very long text takes
            for n in self.sizes:
                found = grams(codes[a : a + (1 << 20) + n - 1], n)
                hits += self._hits(found)
                total += len(found)
        evidence = np.maximum(0, hits - total * self.false_rate) / (1 - self.false_rate) / np.maximum(1e-9, total * self.coverage)
        order = np.argsort(-evidence, kind="stable")
        best = float(evidence[order[0]])
        second = float(evidence[order[1]]) if len(order) > 1 else 0.0
        return self.languages[order[0]], min(1.0, best), (best - second) / best if best else 0.0


def fit_languages(docs: DataFrame, docs_per_language: int = 4000, sizes: tuple[int, ...] = (2, 3, 4), least_share: float = 2e-5, relative: float = 0.2) -> LanguageFilters:
    """Filters learned from ``docs`` (doc_id, text, lang), rows without a lang aside.

    About ``docs_per_language`` documents of each language, chosen by a hash of the row, bound the sample; all
    labels are learned. A language contains an n-gram if it makes up at least ``least_share`` of its n-grams of that size (so at most
    1 / least_share are kept for each size) and at least ``relative`` of the share it has in any language, which
    keeps foreign passages out. The filters' rows are put together by tasks; the driver gets the rows of the finished
    tables, some 2 million for 64 languages at most."""
    known = docs.where(F.col("lang").isNotNull()).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    n_of = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not n_of:
        return LanguageFilters.build([], sizes, [])
    rate = F.create_map(*(F.lit(x) for row in n_of for x in (row.lang, min(1.0, docs_per_language / row.n))))
    sample = known.where(unit_hash("doc_id", "text") < F.try_element_at(rate, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                by.setdefault(lang, []).append(letters(text))
            for lang, found in by.items():
                for n in sizes:
                    gram, times = np.unique(np.concatenate([grams(x, n) for x in found]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array([n] * len(gram), pa.int32()), pa.array(gram.view(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "n", "gram", "times"])

    counts = cut(sample.transform(in_arrow, count, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")))
    total = {(x.lang, x.n): x.t for x in counts.groupBy("lang", "n").agg(F.sum("times").alias("t")).collect()}
    names = [x.lang for x in n_of]
    if not total:
        return LanguageFilters.build(names, sizes, [(np.zeros(0, np.uint64), 0.0)] * len(names))
    share = F.create_map(*(F.lit(x) for (lang, n), t in sorted(total.items()) for x in (f"{lang}\x00{n}", float(t))))
    shares = counts.withColumn("share", F.col("times") / share[F.concat("lang", F.lit("\x00"), F.col("n").cast("string"))])
    most = shares.groupBy("n", "gram").agg(F.max("share").alias("most"))
    kept = cut(shares.where(F.col("share") >= least_share).join(most, ["n", "gram"]).where(F.col("share") >= relative * F.col("most")).select("lang", "gram", "share"))
    has = {x.lang: x for x in kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("share").alias("share")).collect()}
    tables = LanguageFilters.empty([has[x].n if x in has else 0 for x in names])
    place, rows, hashes = {x: k for k, x in enumerate(names)}, [len(x) for x in tables], 3

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            gram = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            for t in np.unique(at // 64):
                mine = at // 64 == t
                bits = np.left_shift(np.uint64(1), (at[mine] % 64).astype(np.uint64)).view(np.int64)
                for k in range(hashes):
                    row = LanguageFilters.rows_of(gram[mine], k, rows[t])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(row), pa.array(bits)], names=["t", "row", "mask"])

    filled = kept.select("lang", "gram").transform(in_arrow, fill, "t int, row long, mask long").groupBy("t", "row").agg(F.bit_or("mask").alias("mask"))
    filled = filled.toArrow()
    of, row, mask = (filled.column(x).to_numpy() for x in ("t", "row", "mask"))
    for t, table in enumerate(tables):
        table[row[of == t]] = mask[of == t].view(np.uint64).astype(table.dtype)
    return LanguageFilters.of(names, sizes, tables, [has[x].share / len(sizes) if x in has else 0.0 for x in names], hashes)


def predict_languages(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, lang_pred, score, margin. Whole texts are read, in bounded pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, margin = zip(*(shared.value.predict(x) for x in texts(batch)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["doc_id", "lang_pred", "score", "margin"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").transform(in_arrow, run, SCHEMA)


def identify_languages(docs: DataFrame, docs_per_language: int = 4000) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out, and predict every row.

    A null, empty or letterless text is ``und`` with score 0; so is every text if no row has a lang. Ties go to the
    alphabetically first language. Repeated rows get equal results; no rows give no rows; other columns are ignored."""
    filters = fit_languages(docs.where(~held_out()), docs_per_language)
    return predict_languages(docs, filters).withColumn("held_out", held_out())


def keep_known_languages(docs: DataFrame, docs_per_language: int = 4000, least_score: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text has no letters or too few known n-grams of any language; columns as they were.

    ``least_score``: of the share of known n-grams that a language's own text has. The rows are scored in place,
    so nothing is joined."""
    filters = fit_languages(docs.where(~held_out()), docs_per_language)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shared.value.predict(x or "") for x in batch.column(place).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score, _ in found], pa.bool_()))

    plain = StructType([StructField(f"c{k}", x.dataType, x.nullable) for k, x in enumerate(docs.schema)])  # as names may hold any characters
    return docs.toDF(*plain.names).transform(in_arrow, run, plain).toDF(*docs.columns)
