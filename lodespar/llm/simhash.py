"""SimHash fingerprints of whole texts and exact links within a Hamming radius, by tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespar.llm.common import cut, in_arrow, quoted, texts
from lodespar.llm.components import connected_components

BITS = 64


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """64 bits, signed as Spark keeps them. ASCII letters are lower-cased, words end at ASCII white space; a bit is
    1 if more than half of the shingles' hashes have it. Fewer than ``width`` words: one shingle; none: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        value = digest(b" ".join(words), seed)
        return value - (1 << BITS) if value >> 63 else value
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash and fingerprint (all long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, width, seed) for x in texts(batch)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fingerprint"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) text_hash", "cast(text as string) text")
    return rows.transform(in_arrow, run, "doc_id long, text_hash long, fingerprint long")


def block_plan(distinct: int, radius: int, tile: int) -> tuple[int, int]:
    """(blocks, agreeing): how many blocks to cut the bits into, and how many of them linked fingerprints surely share.

    With ``blocks`` blocks, at most ``radius`` hold a difference, so all others agree. Each choice finds every link;
    this takes the one with the least rows to send and pairs to compare, if bits were evenly spread."""

    def cost(plan: tuple[int, int]) -> float:
        blocks, agreeing = plan
        met = distinct / 2.0 ** (agreeing * (BITS // blocks))
        return comb(blocks, agreeing) * distinct * (max(1.0, met / tile) + met / 1000)

    return min(((radius + k, k) for k in range(1, 5)), key=cost)


def tile_links(prints: np.ndarray, left: int, radius: int, step: int = 256) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius`` among ``prints``, each part of it ascending by population count.

    ``left``: how many are of the first tile, to be compared with the rest; if all are, with each other. Sub-tiles of
    ``step`` are compared by exclusive-or and bit counts, unless their population counts differ beyond the radius.
    What links have already joined gets no second link, so at most one link a row comes out."""
    ones = np.bitwise_count(prints).astype(np.int64)
    inside = left == len(prints)
    root = np.arange(len(prints))
    links = []
    for a in range(0, left, step):
        b = min(a + step, left)
        for c in range(a if inside else left, len(prints), step):
            d = min(c + step, len(prints))
            if ones[c] - ones[b - 1] > radius or ones[a] - ones[d - 1] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(prints[a:b, None] ^ prints[None, c:d]) <= radius)
            i, j = i + a, j + c
            while True:
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                for k in np.concatenate([np.unique(root[x], return_index=True)[1] for x in (i, j)]).tolist():  # a pair of each part
                    p, q = root[i[k]], root[j[k]]
                    if p != q:
                        links.append((int(i[k]), int(j[k])))
                        root[root == q] = p
    return links


def _tiles(keyed: DataFrame, tile: int) -> DataFrame:
    """choice, bits, tiles of each group of more than ``tile`` rows: ranges lo..hi of population counts of about ``tile`` rows, each with
    the number of parts it is dealt to by hash, if one count alone has more. There are 65 counts at most, so an array is small."""
    key = ["choice", "bits"]
    by_count = keyed.groupBy(*key, "ones").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*key)  # of 65 rows at most
    by_count = by_count.withColumn("of", F.sum("n").over(group)).where(F.col("of") > tile)
    by_count = by_count.withColumn("nth", F.floor((F.sum("n").over(group.orderBy("ones")) - F.col("n")) / tile))
    ranges = by_count.groupBy(*key, "nth").agg(F.min("ones").alias("lo"), F.max("ones").alias("hi"), F.ceil(F.sum("n") / tile).cast("int").alias("parts"))
    return ranges.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi", "parts")).alias("tiles"))


def tile_pairs(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """choice, bits, p, q, second, ones, fingerprint: ``keyed`` (choice, bits, ones, fingerprint) dealt to pairs (p, q) of tiles, p <= q.

    A row goes to its own tile, and to a pair with another one only if that has population counts within the radius of the
    row's; all other pairs are skipped here, before anything is shuffled. ``second``: whether the row is of the tile q."""
    keyed = keyed.join(_tiles(keyed, tile), ["choice", "bits"], "left")
    tiles = F.coalesce("tiles", F.array(F.struct(F.lit(0).alias("lo"), F.lit(BITS).alias("hi"), F.lit(1).alias("parts"))))
    keyed = keyed.withColumn("tiles", tiles)
    number = lambda t, part: (t["lo"].cast("long") * (1 << 32) + part).alias("number")
    mine = F.filter("tiles", lambda t: F.col("ones").between(t["lo"], t["hi"]))
    keyed = keyed.withColumn("mine", F.get(mine, F.lit(0)))
    keyed = keyed.withColumn("own", number(F.col("mine"), F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("mine")["parts"])))
    near = F.filter("tiles", lambda t: F.col("ones").between(t["lo"] - radius, t["hi"] + radius))
    others = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["parts"] - 1), lambda part: number(t, part))))
    keyed = keyed.withColumn("other", F.explode(others))
    return keyed.select("choice", "bits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), "ones", "fingerprint")


def near_links(prints: DataFrame, radius: int = 4, tile: int = 2048) -> DataFrame:
    """For distinct ``fingerprint`` values, links (a, b) that connect exactly those within ``radius``, directly or by others.

    Two fingerprints within the radius agree on some choice of blocks (see ``block_plan``), so each row goes to
    one group for each choice. A group of more than ``tile`` rows is cut into tiles by population count, and each pair of tiles
    within the radius is a group of its own: no task ever holds more than some four tiles, however many fingerprints share the bits."""
    blocks, agreeing = block_plan(prints.count(), radius, tile)
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen) for chosen in combinations(range(blocks), agreeing)]
    signed = [x - (1 << BITS) if x >> 63 else x for x in masks]
    keyed = prints.select("fingerprint", F.bit_count("fingerprint").alias("ones"), F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(x)) for x in signed))).alias("choice", "bits"))
    key, names = ["choice", "bits", "p", "q"], ["choice", "bits", "p", "q", "second", "fingerprint"]
    keyed = tile_pairs(keyed, radius, tile).repartition(*key).sortWithinPartitions(*key, "second", "ones", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the group that the next batch may go on with
        out: list[tuple[int, int]] = []

        def close() -> None:
            rows = np.concatenate(held, axis=1)
            left = int(np.count_nonzero(rows[4] == 0))
            one = rows[2, 0] == rows[3, 0]
            if rows.shape[1] > 1 and (one or 0 < left < rows.shape[1]):
                out.extend((int(rows[5, i]), int(rows[5, j])) for i, j in tile_links(rows[5].view(np.uint64), left, radius))

        def found() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            rows = np.stack([batch.column(x).cast(pa.int64()).to_numpy(zero_copy_only=False) for x in names])
            if not rows.shape[1]:
                continue
            if held and (held[-1][:4, -1] != rows[:4, 0]).any():
                close()
                held = []
            cuts = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), rows.shape[1]]
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                held.append(rows[:, a:b])
                if k < len(bounds) - 2:
                    if len(held) > 1 or b - a > 1:
                        close()
                    held = []
            yield found()
        if held:
            close()
            yield found()

    return keyed.select(*names).transform(in_arrow, run, "a long, b long")


def _components(rows: DataFrame, radius: int, tile: int, best) -> tuple[DataFrame, DataFrame]:
    """From ``fingerprints``: fingerprint, best, root of every distinct one (root null if nothing links it), and root, best of every component.

    ``best``: an aggregate that is the least of something. Fingerprints that nothing links stay out of the grouping."""
    own = rows.groupBy("fingerprint").agg(best.alias("best"))
    reached = cut(connected_components(near_links(own.select("fingerprint"), radius, tile)))
    named = own.join(reached.withColumnRenamed("vertex", "fingerprint"), "fingerprint", "left")
    return named, named.where("root is not null").groupBy("root").agg(F.min("best").alias("best"))


def simhash_components(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, tile: int = 2048, salts: int = 16) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row of ``docs`` (doc_id, text).

    component_id: the least doc_id of all rows that links within ``radius`` reach, itself included (null if all are
    null). Equal fingerprints are one vertex, so thousands of copies are one row to compare. Repeated doc_ids with
    different texts are rows of their own; null and empty texts have fingerprint zero and are linked like any
    other; no rows give no rows; other columns are ignored. A component's fingerprints meet its id in ``salts`` groups."""
    rows = cut(fingerprints(docs, width, seed))
    named, parts = _components(rows, radius, tile, F.min("doc_id"))
    named = cut(named)
    salt = F.pmod(F.xxhash64("fingerprint", F.lit(11)), F.lit(salts)).cast("int")
    parts = parts.select("root", F.col("best").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    linked = named.where("root is not null").select("fingerprint", "root", salt.alias("salt")).join(parts, ["root", "salt"]).select("fingerprint", "component_id")
    alone = named.where("root is null").select("fingerprint", F.col("best").alias("component_id"))
    return rows.join(linked.unionByName(alone), "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_dedup(docs: DataFrame, radius: int = 4, tile: int = 2048) -> DataFrame:
    """``docs`` with one row of each component kept: the one with the least doc_id (null after all others), of several that
    with the least text hash, and any one of rows that equal it in both; columns as they were."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = cut(fingerprints(docs.select("doc_id", "text")))
    named, parts = _components(rows, radius, tile, F.min(order))
    keep = parts.select("best.*").unionByName(named.where("root is null").select("best.*"))
    times = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_hash"] == y["text_hash"])
    keep = keep.join(times, same(keep, times), "left").select(keep["doc_id"].alias("keep_id"), keep["text_hash"].alias("keep_hash"), F.coalesce("n", F.lit(1)).alias("n"))
    keep = cut(keep)
    here = docs.select(F.struct(*(quoted(x) for x in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"))
    match = (F.col("own_hash") == F.col("keep_hash")) & F.col("own_id").eqNullSafe(F.col("keep_id"))
    kept = here.join(keep.where("n = 1"), match, "left_semi")
    repeated = keep.where("n > 1")
    if not repeated.isEmpty():
        again = here.join(repeated, match, "left_semi").groupBy("own_id", "own_hash").agg(F.first("row").alias("row"))
        kept = kept.select("row").unionByName(again.select("row"))
    return kept.select(*(F.col("row").getField(x).alias(x) for x in docs.columns))
