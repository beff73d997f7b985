"""Toxicity by a factorization machine over hashed terms: linear weights and pairwise interactions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.llm.common import cut, held_out, in_arrow, text_hash, texts, unit_hash

_TERM = re.compile(r"\w+")
#: Lengths of the prefixes that stand for a stem.
PREFIXES = (4, 6, 8)
#: A term is a bucket of hashed strings and a level: 0 for a word, else that of how many words share a prefix.
LEVELS = 64


def levels(times: int) -> int:
    """The highest level that ``times`` words reach: 1 to 16 for as many, then one more for each doubling."""
    return times if times <= 16 else 12 + (times - 1).bit_length()


def terms(text: str, buckets: int) -> set[int]:
    """The terms of a whole text: its lower-cased words, and each prefix at all levels that the words sharing it reach."""
    words = set(_TERM.findall(text.lower()))
    found = {text_hash(x, buckets) * LEVELS for x in words}
    for n in PREFIXES:
        for prefix, times in Counter([x[:n] for x in words if len(x) >= n]).items():
            at = text_hash(f"{prefix}-", buckets) * LEVELS
            found.update(range(at + 1, at + 1 + levels(times)))
    return found


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms i that a text has.

    ``place``: of each term that the machine knows. ``idle`` remembers words without any known term, ``active`` the others'
    places and prefixes; each is emptied at ``memory`` words."""

    place: dict[int, int]
    buckets: int
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    memory: int = 300_000
    idle: set[str] = field(default_factory=set)
    active: dict[str, tuple[int | None, list[str]]] = field(default_factory=dict)
    stems: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.stems = {x // LEVELS for x in self.place if x % LEVELS}

    def _learn(self, word: str) -> None:
        own = self.place.get(text_hash(word, self.buckets) * LEVELS)
        prefixes = [word[:n] for n in PREFIXES if len(word) >= n and text_hash(f"{word[:n]}-", self.buckets) in self.stems]
        if own is None and not prefixes:
            self.idle.add(word)
        else:
            self.active[word] = own, prefixes

    def features(self, text: str) -> list[int]:
        """The places of the known terms that a text has, ascending: those of ``terms``."""
        words = set(_TERM.findall(text.lower()))
        if len(self.idle) > self.memory:
            self.idle.clear()
        if len(self.active) > self.memory:
            self.active.clear()
        rest = words.difference(self.idle)
        for x in rest:
            if x not in self.active:
                self._learn(x)
        known = [self.active[x] for x in rest if x in self.active]
        found = {own for own, _ in known}
        for prefix, times in Counter([x for _, prefixes in known for x in prefixes]).items():
            at = text_hash(f"{prefix}-", self.buckets) * LEVELS
            found.update(map(self.place.get, range(at + 1, at + 1 + levels(times))))
        found.discard(None)
        return sorted(found)

    def raw(self, at: list[int] | np.ndarray) -> float:
        v = self.factor[at]
        return self.bias + self.weight[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.features(text)), -30, 30))))


class _Rows:
    """Rows' features as dense blocks of at most ``cells`` numbers; kept if one block holds all, else made anew each time."""

    def __init__(self, rows: list, features: int, cells: int = 1 << 24):
        self.size, self.features, self.step = len(rows), features, max(1, cells // max(1, features))
        self.first = np.cumsum([0, *map(len, rows)])
        self.column = np.concatenate([np.zeros(0, np.int32), *(np.asarray(r, np.int32) for r in rows)])
        self.kept = self._block(0) if self.step >= self.size else None

    def _block(self, a: int) -> np.ndarray:
        b = min(a + self.step, self.size)
        x = np.zeros((b - a, self.features), np.float32)
        x[np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1])), self.column[self.first[a] : self.first[b]]] = 1
        return x

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, self.size, self.step):
            yield slice(a, a + self.step), self._block(a) if self.kept is None else self.kept


def fit_machine(rows: list, label: np.ndarray, weight_of: np.ndarray, features: int, rank: int = 8, epochs: int = 200, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss with L2 decay, by full-batch Adam. ``rows``: each row's features, from 0."""
    x, total = _Rows(rows, features), weight_of.sum()
    prior = float((label * weight_of).sum() / total)
    p = {"b": np.array([np.log((prior + 1e-6) / (1 - prior + 1e-6))]), "w": np.zeros(features), "v": np.random.default_rng(seed).normal(0, 0.05, (features, rank))}
    m, s = {k: np.zeros_like(y) for k, y in p.items()}, {k: np.zeros_like(y) for k, y in p.items()}
    for t in range(1, epochs + 1):
        of_feature = np.column_stack([p["v"], p["w"] - 0.5 * (p["v"] ** 2).sum(1)]).astype(np.float32)
        back, wrong = np.zeros((features, rank + 1)), 0.0
        for at, block in x.blocks():
            both = block @ of_feature
            of_row = both[:, :-1].astype(float)
            raw = p["b"][0] + both[:, -1] + 0.5 * (of_row**2).sum(1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[at]) * weight_of[at] / total
            back += block.T @ np.column_stack([error[:, None] * of_row, error]).astype(np.float32)
            wrong += error.sum()
        grad = {"b": np.array([wrong]), "w": back[:, -1] + decay * p["w"], "v": back[:, :-1] - back[:, -1:] * p["v"] + decay * p["v"]}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return float(p["b"][0]), p["w"], p["v"]


def pair_scores(first: np.ndarray, column: np.ndarray, error: np.ndarray, spread: np.ndarray, a: int, b: int, block: int, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For the features of block ``a`` and those of block ``b``, the most standard errors of any pair of them.

    ``first``, ``column``: the rows' features, ascending in a row. A pair's sum of the errors of the rows that have both is
    held against its spread, and that of ``least_rows`` average rows, so that a few rows alone stand for nothing."""
    total, var = np.zeros((block, block), np.float32), np.zeros((block, block), np.float32)
    of, step = np.repeat(np.arange(len(first) - 1), np.diff(first)), 2048

    def dense(k: int, r: int, part: slice) -> np.ndarray:
        x = np.zeros((min(step, len(first) - 1 - r), block), np.float32)
        mine = column[part] // block == k
        x[of[part][mine] - r, column[part][mine] % block] = 1
        return x

    for r in range(0, len(first) - 1, step):
        part = slice(first[r], first[min(r + step, len(first) - 1)])
        x = dense(a, r, part)
        y = x if a == b else dense(b, r, part)
        total += (x * error[r : r + step, None].astype(np.float32)).T @ y
        var += (x * spread[r : r + step, None].astype(np.float32)).T @ y
    z = np.abs(total) / np.sqrt(var + np.float32(least_rows * spread.mean() + 1e-12))
    if a == b:
        np.fill_diagonal(z, 0)
    return z.max(1), z.max(0)


def interacting(spark: SparkSession, features: int, error: np.ndarray, spread: np.ndarray, rows: list[np.ndarray], least_rows: int, least_z: float, block: int = 1024) -> list[int]:
    """The features (0 to ``features``) with a pair in which the machine's errors agree by at least ``least_z`` standard errors.

    All pairs of blocks are tasks of their own; what is broadcast are the rows' features, bounded as the sample is."""
    blocks = -(-features // block)
    shared = spark.sparkContext.broadcast((np.cumsum([0, *map(len, rows)]), np.concatenate([np.zeros(0, np.int32), *rows]), error, spread))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                for k, z in zip((a, b), pair_scores(*shared.value, a, b, block, least_rows), strict=True):
                    yes = np.flatnonzero(z >= least_z)
                    yield pa.RecordBatch.from_arrays([pa.array(yes + k * block, pa.int64())], names=["feature"])

    tasks = [(a, b) for a in range(blocks) for b in range(a, blocks)]
    pairs = spark.createDataFrame(tasks, "a int, b int").repartition(len(tasks)) if tasks else None
    return sorted(x.feature for x in pairs.transform(in_arrow, scan, "feature long").distinct().collect()) if tasks else []


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int, longest: int) -> tuple[DataFrame, dict[int, float], float]:
    """toxic, text, times of the sample; each class's share in it; and the smoothed share of label 1.

    Of several labels of a doc_id the highest counts; rows without a label (0 or 1) or doc_id don't. Each class's rows are
    counted and about ``rows_per_class`` different ones are chosen by a hash; equal rows are one, ``times`` as heavy. Only
    texts of at most ``longest`` characters are learned from (all are scored), which bounds the sample's bytes. No text is shuffled but
    the sample's: the chosen keys, at most some 2 * rows_per_class, are broadcast."""
    own = labels.where("doc_id is not null and cast(toxic as int) in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest).withColumn("text_hash", F.xxhash64("text"))
    keys = cut(docs.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")).join(own, "doc_id"))
    n_of = {x.toxic: (x.n, x.rows) for x in keys.groupBy("toxic").agg(F.sum("times").alias("n"), F.count("*").alias("rows")).collect()}
    rate = {k: min(1.0, rows_per_class / n_of[k][1]) if k in n_of else 1.0 for k in (0, 1)}
    chosen = keys.where(unit_hash("doc_id", "text_hash") < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    sample = docs.join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("toxic", "text", "times")
    return sample, rate, (n_of.get(1, (0, 0))[0] + 0.5) / (sum(n for n, _ in n_of.values()) + 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = 6_000, longest: int = 1 << 20, buckets: int = 1 << 26, least_rows: int = 5, least_z: float = 4.0, pair_rows: int = 20, pair_share: float = 0.02, pair_z: float = 6.0) -> FactorizationMachine:
    """A machine for ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text), learned from a bounded sample (see ``labelled_sample``).

    Its terms are all of those in ``least_rows`` documents of the sample or more that are at least ``least_z`` standard errors
    from independence of the label; and, since a term may tell only together with another, all that are in a pair in which
    the errors of a first machine agree by ``pair_z`` standard errors. For that every pair is looked at of terms that ``pair_share`` of the
    sample, and ``pair_rows`` documents, have. There is no limit to their number. Weights make up for the choice of the sample."""
    sample, rate, prior = labelled_sample(docs, labels, rows_per_class, longest)
    constant = FactorizationMachine({}, buckets, float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, 1)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("times"), pa.array([sorted(terms(x, buckets)) for x in texts(batch)], pa.list_(pa.int64()))], names=["toxic", "times", "terms"])

    sample = cut(sample.transform(in_arrow, hashed, "toxic int, times long, terms array<long>"))
    got = {x.toxic: x.n for x in sample.groupBy("toxic").agg(F.sum("times").alias("n")).collect()}
    pos, neg = got.get(1, 0), got.get(0, 0)
    if not pos or not neg:
        return constant
    mean = F.col("n") / (pos + neg)
    z = F.abs(F.col("a") / pos - F.col("b") / neg) / F.sqrt(mean * (1 - mean) * (1 / pos + 1 / neg) + 1e-12)
    by_term = sample.select("toxic", "times", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.col("toxic") * F.col("times")).alias("a"), F.sum((1 - F.col("toxic")) * F.col("times")).alias("b"), F.sum("times").alias("n"))
    by_term = by_term.select("term", ((F.col("n") >= least_rows) & (z >= least_z)).alias("tells"), (F.col("n") >= max(pair_rows, pair_share * (pos + neg))).alias("common"))
    known = by_term.where("tells or common").orderBy("term").collect()  # of the sample's terms
    place = {x.term: k for k, x in enumerate(known)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array([place[y] for y in x if y in place], "<i4").tobytes() for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("times"), pa.array(found, pa.binary())], names=["toxic", "times", "terms"])

    rows = sample.transform(in_arrow, placed, "toxic int, times long, terms binary").collect()  # bounded as the sample is
    rows.sort(key=lambda x: (x.toxic, bytes(x.terms), x.times))  # the same sums whatever order they come in
    label, times, every = np.array([x.toxic for x in rows], float), np.array([x.times for x in rows], float), [np.frombuffer(x.terms, "<i4") for x in rows]

    def only(features: list[int]) -> list[np.ndarray]:
        at = np.full(len(known), -1, np.int32)
        at[features] = np.arange(len(features))
        return [(y := at[x])[y >= 0] for x in every]

    tell, common = [k for k, x in enumerate(known) if x.tells], [k for k, x in enumerate(known) if x.common]
    first = FactorizationMachine({}, buckets, *fit_machine(only(tell), label, times, len(tell)))
    p = 1 / (1 + np.exp(-np.clip([first.raw(x) for x in only(tell)], -4, 4)))
    paired = interacting(docs.sparkSession, len(common), (label - p) * times, p * (1 - p) * times, only(common), pair_rows, pair_z)
    chosen = sorted({*tell, *(common[k] for k in paired)})
    weight = times * np.where(label == 1, 1 / rate[1], 1 / rate[0])
    return FactorizationMachine({known[k].term: n for n, k in enumerate(chosen)}, buckets, *fit_machine(only(chosen), label, weight, len(chosen)))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, score, predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.fromiter((shared.value.score(x) for x in texts(batch)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").transform(in_arrow, run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = 6_000) -> DataFrame:
    """Learn from the labels that aren't held out, and score every row of ``docs``.

    Null and empty texts get the score of a text without known terms. Without labels of both kinds the score is
    the smoothed share of label 1. Repeated rows get equal scores; no rows give no rows; other columns are ignored."""
    machine = fit_toxicity(docs, labels.where(~held_out()), rows_per_class)
    return score_toxicity(docs, machine).withColumn("held_out", held_out())
