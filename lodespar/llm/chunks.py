"""Line dedup in content-defined chunks, with DataFrame functions alone.

Rolling hashes over line hashes choose the places: a chunk starts where the rolling hash of two lines is no greater
than the one before or after it. A run of three equal lines has such a place in all its copies, whatever stands around it; the
places of a longer run are one or two lines apart. Chunks whose rolling hash repeats are extended by a line to both sides, and
what is equal byte by byte goes. Disjoint chunks from boundary to boundary can't do that: their ends depend on the lines
outside the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespar.llm.common import cut, quoted

#: The order of documents: null doc_ids first.
_NO_ID = -(1 << 63)
_PLACE = ("owner", "text_hash", "start")


def _keyed(docs: DataFrame) -> DataFrame:
    """owner, text_hash, text of ``docs`` (doc_id, text); equal rows are one document."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("owner"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _split(rows: DataFrame, long_words: int) -> DataFrame:
    """``rows`` with ``lines``; ``singles``, the lines of more than ``long_words`` words; and ``pairs``, each line with words and the next such.

    Both are arrays of start, n_lines, hash; a pair's ``chosen`` says whether it starts a chunk: at the places that the rolling
    hashes choose, and wherever two lines are long enough to have more than ``long_words`` words. Lines are what newlines separate."""

    def line(x: Column, k: Column) -> Column:
        wide = F.length(x) > 2 * long_words
        long = F.when(wide, F.size(F.split(F.trim(x), r"\s+")) > long_words).otherwise(False)
        return F.struct(k.alias("k"), F.xxhash64(x).alias("h"), F.length(x).alias("size"), long.alias("long"), F.rlike(x, F.lit(r"\S")).alias("solid"))

    def pair(x: Column, y: Column) -> Column:
        span = y["k"] - x["k"] + 1
        return F.struct(x["k"].alias("start"), span.alias("n_lines"), F.xxhash64(x["h"], y["h"], span).alias("hash"), (x["size"] + y["size"] >= 2 * long_words).alias("wide"))

    def choose(p: Column, near: Column) -> Column:
        least = near["a"].isNull() | near["b"].isNull() | (p["hash"] <= near["a"]) | (p["hash"] <= near["b"])
        return F.struct(p["start"].alias("start"), p["n_lines"].alias("n_lines"), p["hash"].alias("hash"), (p["wide"] | least).alias("chosen"))

    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("solid", F.filter(F.transform("lines", line), lambda x: x["solid"]))
    n = F.greatest(F.size("solid") - 1, F.lit(0))
    rows = rows.withColumn("pairs", F.zip_with(F.slice("solid", 1, n), F.slice("solid", 2, n), pair))
    rolls, none = F.transform("pairs", lambda p: p["hash"]), F.array(F.lit(None).cast("long"))
    near = F.zip_with(F.slice(F.concat(none, rolls), 1, F.size("pairs")), F.concat(F.slice(rolls, 2, F.size("pairs")), none), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    near = F.when(F.size("pairs") > 0, near).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    single = lambda x: F.struct(x["k"].alias("start"), F.lit(1).alias("n_lines"), F.xxhash64(x["h"], F.lit(1)).alias("hash"))
    return rows.select("*", F.zip_with("pairs", near, choose).alias("chunks"), F.transform(F.filter("solid", lambda x: x["long"]), single).alias("singles")).drop("pairs", "solid").withColumnRenamed("chunks", "pairs")


def line_chunks(docs: DataFrame, long_words: int = 50) -> DataFrame:
    """owner, text_hash, at, hash of each chunk of ``docs`` (doc_id, text): ``at`` is its place among the pairs, or -1 less that among the long lines."""
    some = _keyed(docs).where(F.contains("text", F.lit("\n")) | (F.length("text") > 2 * long_words))
    at = lambda k: k.cast("int").alias("at")
    pairs = F.filter(F.transform("pairs", lambda p, k: F.struct(at(k), p["hash"].alias("hash"), p["chosen"].alias("chosen"))), lambda p: p["chosen"])
    singles = F.transform("singles", lambda p, k: F.struct(at(-1 - k), p["hash"].alias("hash"), F.lit(True).alias("chosen")))
    return _split(some, long_words).select("owner", "text_hash", F.inline(F.concat(pairs, singles))).drop("chosen")


def _bodies(docs: DataFrame, wanted: DataFrame, long_words: int) -> DataFrame:
    """owner, text_hash, start, n_lines, hash, body of the chunks that ``wanted`` (owner, text_hash, ats) names, and of the pairs
    a line before and after them: those start chunks in some of a run's copies and not in others."""
    rows = _split(_keyed(docs).join(wanted, ["owner", "text_hash"]), long_words)
    near = F.flatten(F.transform(F.filter("ats", lambda k: k >= 0), lambda k: F.array(k - 1, k + 1)))
    near = F.filter(F.array_except(near, "ats"), lambda k: (k >= 0) & (k < F.size("pairs")))
    rows = rows.withColumn("every", F.concat("ats", near))

    def chunk(k: Column) -> Column:
        start, n = (F.when(k >= 0, F.get("pairs", k)[x]).otherwise(F.get("singles", -1 - k)[x]) for x in ("start", "n_lines"))
        own = F.when(k >= 0, F.get("pairs", k)["hash"]).otherwise(F.get("singles", -1 - k)["hash"])
        return F.struct(start.alias("start"), n.alias("n_lines"), own.alias("hash"), F.array_join(F.slice("lines", start + 1, n), "\n").alias("body"))

    return rows.select("owner", "text_hash", F.inline(F.transform("every", chunk)))


def repeated_chunks(docs: DataFrame, long_words: int = 50) -> DataFrame:
    """owner, text_hash, start, n_lines of each chunk that an earlier one equals byte by byte, by owner (null doc_id first), text hash and place.

    Hashes alone are shuffled first, counted before the shuffle; bodies only of chunks whose hash repeats, and of their
    neighbours. They are grouped by their bytes, again aggregated before the shuffle. Where a hash has one body only, which is then as
    good as the body, places without bodies join that hash's first place; hashes that several bodies share, if there are any,
    join by bytes. What follows those joins shuffles by document, so Spark can split a chunk that a third of all documents hold."""
    chunks = cut(line_chunks(docs, long_words))
    often = chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    wanted = chunks.join(often, "hash").groupBy("owner", "text_hash").agg(F.collect_set("at").alias("ats"))
    each = cut(_bodies(docs, wanted, long_words))
    place = F.struct(*_PLACE)
    groups = each.groupBy("hash", "body").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    known = cut(groups.groupBy("hash").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("bodies")).where("first < last"))
    gone = each.drop("body").join(known.where("bodies = 1").select("hash", "first"), "hash").where(place != F.col("first"))
    shared = known.where("bodies > 1").select("hash")
    if not shared.isEmpty():
        among = each.join(shared, "hash")
        first = among.groupBy("hash", "body").agg(F.min(place).alias("first"))
        gone = gone.unionByName(among.join(first, ["hash", "body"]).where(place != F.col("first")).drop("body"))
    return gone.select(*_PLACE, "n_lines")


def _removed(docs: DataFrame, long_words: int) -> DataFrame:
    """row (struct of the columns of ``docs``), kept (the text that stays; null if none goes), removed_chunks, removed_lines."""
    gone = repeated_chunks(docs, long_words).groupBy(F.col("owner").alias("gone_owner"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set(F.struct("start", "n_lines")).alias("gone"))
    here = docs.select(F.struct(*(quoted(x) for x in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("owner"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    both = here.join(gone, (F.col("text_hash") == F.col("gone_hash")) & (F.col("owner") == F.col("gone_owner")), "left")
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col("row")["text"].cast("string"), "\n")))
    both = both.withColumn("dropped", F.array_distinct(F.flatten(F.transform("gone", lambda x: F.sequence(x["start"], x["start"] + x["n_lines"] - 1)))))
    both = both.withColumn("stays", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")))
    stretches = F.size(F.array_except("dropped", F.transform("dropped", lambda k: k + 1)))
    kept = F.when(F.col("gone").isNotNull(), F.array_join(F.transform("stays", lambda k: F.get("lines", k)), "\n"))
    count = lambda x: F.when(F.col("gone").isNotNull(), x).otherwise(0).cast("long")
    return both.select("row", kept.alias("kept"), count(stretches).alias("removed_chunks"), count(F.size("dropped")).alias("removed_lines"))


def remove_repeated_chunks(docs: DataFrame, long_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, any others) with what repeats taken out of ``text``; also removed_chunks, removed_lines (long).

    Every run of three or more lines that an earlier document has too goes, wherever it stands, and so does a line, or two, of more
    than ``long_words`` words; of two short lines that repeat, those that make a chunk. Blank lines count as part of what is around
    them. Each line that goes stays in an earlier place. The lines that stay are joined by newlines; a text
    all of which is repeated becomes empty; null and empty texts stay. Rows with the same doc_id and text are one document
    and get the same text; what a document repeats within itself goes too. ``removed_chunks`` counts stretches of removed
    lines. Columns of ``docs`` with a name of the added ones are replaced. No rows give no rows."""
    names = [x for x in docs.columns if x not in ("removed_chunks", "removed_lines")]
    text = F.coalesce(F.col("kept"), F.col("row")["text"])
    return _removed(docs, long_words).select(*((text if x == "text" else F.col("row").getField(x)).alias(x) for x in names), "removed_chunks", "removed_lines")


def dedup_lines(docs: DataFrame, long_words: int = 50, size: str = "n_chars") -> DataFrame:
    """``docs`` with what repeats taken out of ``text``; a column ``size`` follows the text where it changed; all others as they were."""

    def column(x: str) -> Column:
        old = F.col("row").getField(x)
        if x == "text":
            return F.coalesce(F.col("kept"), old)
        return F.when(F.col("kept").isNull(), old).otherwise(F.length("kept").cast(docs.schema[x].dataType)) if x == size else old

    return _removed(docs, long_words).select(*(column(x).alias(x) for x in docs.columns))
