"""The operators on Spark: against brute force, on odd rows, and on empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodespar.llm import chunks, common, components, decontaminate, html, language, packing, pii, queries, rans, simhash, tokens, topk, toxicity
from tests.duck import assert_same, connect

HEAD = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", "en", "s", 6),
    (4, "one line only", "en", "s", 13),
    (4, "one line only", "en", "s", 13),
    (4, "same id, other text", None, "s", 19),
    (None, "no id at all", "en", None, 12),
    (None, None, None, None, None),
    (5, LONG, "en", "s", len(LONG)),
    (6, "x" * 20_000, "de", "s", 20_000),
    (7, "mail a@b.example now", "en", "s", 20),
    (8, "日本語のテキスト", "ja", "s", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns beside the usual ones that have the operators' own names."""
    df = spark.createDataFrame(ODD, HEAD)
    for x in ("score", "fingerprint", "component_id", "lang_pred", "hash", "body", "start", "n_tokens", "spans", "row", "gone", "held_out", "removed_lines"):
        df = df.withColumn(x, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], HEAD)


@pytest.fixture(scope="module")
def docs(spark, small):
    return common.table(spark, small, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 0, int(k in (4, 7))) for k in range(9)] + [(None, 0, 1), (3, 0, None), (3, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one line only"), (1, "one line only"), (2, None), (3, ""), (None, "no id at all")], "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], tokens.ID)


# op1


def test_personal_data(docs, odd, empty):
    for df in (docs.limit(60), odd):
        texts = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=repr)
        want = []
        for doc, text in texts:
            base = [(k, a, b) for k, a, b, ok in pii.base_spans(text) if ok]
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            want.append((doc, *(sum(x[0] == k for x in base) for k in pii.BASE), hashlib.sha256(said.encode()).hexdigest()))
        got = pii.find_personal_data(df).collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            kinds = [pii.KINDS.index(x.split(":")[0]) for x in r.spans.split(",") if x]
            assert kinds == sorted(kinds) and len(kinds) == r.n_spans == sum(tuple(r)[1:5]) + r.added
    assert pii.find_personal_data(empty).count() == 0


def test_spans_like_brute_force(spark, docs):
    """Votes counted, beliefs and classifier learned, and spans decided again in plain Python, from all candidates."""
    from collections import Counter

    extra = [(900 + k, f"ssn {k:03}-12-34{k:02} and {'0' if k % 2 else '6'}66-00-0000, key {'ab1-' * (5 + k)} iban GB82 WEST 1234 5698 7654 {30 + k}") for k in range(9)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = [(r.doc_id, pii.candidates(r.text or "")) for r in df.collect()]
    belief = pii.reliabilities([(*k, n) for k, n in sorted(Counter((k, v) for _, (_, voted) in found for k, _, _, v, _ in voted).items())])
    every = sorted((k, v, f) for _, (_, voted) in found for k, _, _, v, f in voted)
    model = pii.fit_spans(every, np.array([belief[k, v] for k, v, _ in every]))
    want = {}
    for doc, (base, voted) in found:
        spans = base + [(k, a, b) for k, a, b, v, f in voted[len(base) :] if model.probability(k, v, f) >= 0.5]
        want[doc] = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1])))
    assert {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()} == want
    assert any(v[0] == "-" for _, v, _ in every)


def test_long_secrets_and_addresses_are_candidates():
    key = "".join(f"a{k}B" for k in range(60))
    _, voted = pii.candidates(f"token {key} and mail {'long' * 30} (at) example (dot) com now")
    assert [(k, b - a) for k, a, b, _, _ in voted] == [("secret", len(key)), ("email", 120 + len(" (at) example (dot) com"))]
    pii.candidates("%" * 200_000 + " (at) " + "x-" * 100_000 + "dot")


def test_written_out_data_is_added(spark):
    hidden = [(k, f"please write to joe{k} (at) example (dot) com or phone 555-{100 + k}-4567 about it", None, None, None) for k in range(40)]
    plain = [(100 + k, "nothing of that kind stands in here 12-3", None, None, None) for k in range(40)]
    got = pii.find_personal_data(spark.createDataFrame(hidden + plain, HEAD)).collect()
    assert all((r.added == 2) == (r.doc_id < 100) and (r.added == 0) == (r.doc_id >= 100) for r in got)


# op2


def test_languages(docs, odd, empty):
    got = language.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 200 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    found = language.identify_languages(odd).collect()
    assert len(found) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert language.identify_languages(empty).count() == 0


def test_filters_put_together_by_tasks_are_the_plain_ones(docs):
    """All counts and tables again, by dictionaries over the whole texts; and the predictions from them."""
    from collections import Counter

    found = [r for r in docs.where(~common.held_out()).where("lang is not null").collect()]
    got, sizes = language.fit_languages(docs.where(~common.held_out())), (2, 3, 4)
    names = sorted({r.lang for r in found})
    counts = {(x, n): Counter() for x in names for n in sizes}
    for r in found:
        for n in sizes:
            counts[r.lang, n].update(language.grams(language.letters(r.text or ""), n).tolist())
    share = {k: {g: t / sum(c.values()) for g, t in c.items()} for k, c in counts.items()}
    kept = []
    for x in names:
        own = {(n, g): s for n in sizes for g, s in share[x, n].items() if s >= 2e-5 and s >= 0.2 * max(share[y, n].get(g, 0) for y in names)}
        kept.append((np.array([g for _, g in own], np.uint64), sum(own.values()) / len(sizes)))
    plain = language.LanguageFilters.build(names, sizes, kept)
    assert got.languages == names and all((a == b).all() for a, b in zip(got.tables, plain.tables, strict=True)) and np.allclose(got.coverage, plain.coverage)
    for r in language.identify_languages(docs).collect():
        text = docs.where(F.col("doc_id") == r.doc_id).first().text or "" if r.doc_id < 12 else None
        assert text is None or (r.lang_pred, round(r.score, 9)) == (plain.predict(text)[0], round(plain.predict(text)[1], 9))


def test_any_number_of_labels_is_learned(spark):
    word = lambda k: f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k * 7 % 26)}" * 3
    made = spark.createDataFrame([(k, " ".join([word(k)] * 5), f"l{k:03}") for k in range(600)], "doc_id long, text string, lang string")
    filters = language.fit_languages(made)
    assert len(filters.languages) == 600 and len(filters.tables) == 10 and all(filters.predict(word(k))[0] == f"l{k:03}" for k in (0, 63, 64, 300, 599))


def test_language_stage_keeps_clean_rows(docs, odd):
    kept = language.keep_known_languages(docs)
    assert kept.columns == docs.columns and kept.count() == 200
    left = language.keep_known_languages(odd)
    assert left.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in left.collect()}


# op3


def brute_components(found):
    prints = [simhash.fingerprint(t or "") for _, t in found]
    root = list(range(len(found)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(found)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 4 and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(found):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted(((doc, prints[k], least.get(find(k))) for k, (doc, _) in enumerate(found)), key=repr)


def test_components_of_texts(spark, docs, odd, empty):
    for df in (docs, odd):
        assert rows(simhash.simhash_components(df)) == brute_components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert simhash.simhash_components(empty).count() == 0
    few = simhash.near_dedup(docs)
    assert few.columns == docs.columns and few.count() == len({x[2] for x in brute_components([(r.doc_id, r.text) for r in docs.collect()])})


@pytest.mark.parametrize("tile", [4, 64])
def test_links_over_many_tiles(spark, tile, monkeypatch):
    rng = random.Random(7)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randint(0, 63)
            prints.add(x)
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    for plan in ((5, 1), (6, 2), (7, 3)):
        monkeypatch.setattr(simhash, "block_plan", lambda *_, plan=plan: plan)
        links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), tile=tile).collect()
        want = {x: min(y for y in prints) for x in prints}
        root = {x: x for x in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert ((a ^ b) % 2**64).bit_count() <= 4
            root[find(a % 2**64)] = find(b % 2**64)
        for x in prints:
            for y in prints:
                assert (x ^ y).bit_count() > 4 or find(x) == find(y)
        assert want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.vertex: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}}
    assert got == {r.vertex: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), hot=5).collect()}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tile_pairs_beyond_the_radius_are_never_shuffled(spark):
    rng = random.Random(1)
    made = {sum(1 << b for b in rng.sample(range(63), rng.randint(5, 55))) for _ in range(600)}
    keyed = spark.createDataFrame([(0, 0, x.bit_count(), x) for x in made], "choice int, bits long, ones int, fingerprint long")
    found = simhash.tile_pairs(keyed, 4, 20).collect()
    tile_of = {r.fingerprint: r.p for r in found if r.p == r.q}
    assert set(tile_of) == made and max(sum(t == x for t in tile_of.values()) for x in set(tile_of.values())) <= 60
    met = {(r.p, r.q) for r in found}
    assert len(met) < 0.6 * len(set(tile_of.values())) ** 2 / 2
    at = {(r.p, r.q, r.fingerprint) for r in found}
    for x in made:
        for y in made:
            p, q = sorted((tile_of[x], tile_of[y]))
            assert abs(x.bit_count() - y.bit_count()) > 4 or {(p, q, x), (p, q, y)} <= at
    one = simhash.tile_pairs(spark.createDataFrame([(0, 0, 3, (1 << a) | (1 << b) | (1 << c)) for a in range(9) for b in range(a) for c in range(b)], "choice int, bits long, ones int, fingerprint long"), 4, 10).collect()
    assert len({r.p for r in one}) == 9 and len({r.fingerprint for r in one}) == 84  # parts of a single count


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    made = [(3, text, "a"), (2, text, "b"), (2, text, "c"), (2, "other words here", "d"), (None, text, "e"), (None, "alone", "f"), (None, "alone", "g"), (None, "by itself too", "h"), (7, "other words here", "i"), (9, None, "j"), (8, "", "k")]
    docs = spark.createDataFrame(made, "doc_id long, text string, `a.b` string").withColumn("kept_id", F.lit(1)).withColumn("keep_id", F.lit(1)).withColumn("row", F.lit(1))
    got = simhash.near_dedup(docs)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns and sorted(kept, key=repr) == sorted([(2, text), (2, "other words here"), (None, "alone"), (None, "by itself too"), (8, "")], key=repr)


# op4


def test_top_k_like_sql(spark, small):
    assert_same(queries.op4_top_k(spark, small), connect(small), queries.oracle_sql()["op4_top_k"])


def test_top_k_of_odd_vectors(spark):
    vectors = [(0, [1.0, -0.5]), (1, [1.0, -0.5]), (2, [0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (None, [9.0, 9.0]), (6, []), (7, [float("inf")]), (8, [1.0, -0.5]), (8, [1.0, -0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, k=3, query_rows=2, block_rows=2, least_blocks=3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 81920), (0, 2, 8, 81920), (0, 3, 8, 81920)]
    assert topk.top_k(df.where("vec_id in (0, 2)"), F.lit(True), k=5).count() == 2
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# op5


def test_pages(spark, small):
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<article><p>a &amp; b"), (3, "w", "<p>" + "long text " * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.url): r for r in html.extract_pages(odd).collect()}
    assert got[1, None].text == "" and got[2, "u"].n_chars == 0 and got[None, "v"].text == "a & b" and got[3, "w"].n_chars == 10 * 50_000 - 1
    assert html.extract_pages(odd).count() == 5 and html.extract_pages(odd.limit(0)).count() == 0
    assert queries.op5_main_text(spark, small).where("n_chars = 0").count() == 0


# op6, op10


def test_token_files(docs, odd, empty):
    tokenizer = whole()
    found = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: x[0])
    got = sorted(rans.token_files(docs, segment_tokens=20_000).collect(), key=lambda r: r.doc_id)
    start = 0
    for (doc, text), r in zip(found, got, strict=True):
        ids = ids_of(tokenizer, text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    got = sorted(rans.token_files(odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((x[0] for x in ODD), key=lambda x: (x is not None, x or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and sum(r.n_tokens == 1 for r in got) == 3
    assert rans.token_files(empty).count() == 0


def test_packing(docs, odd, empty):
    tokenizer = whole()
    for df in (docs, odd):
        want = sorted((ids_of(tokenizer, r.text, 1).tobytes() for r in df.collect()), key=lambda x: (len(x), x))
        pieces = packing.pack_documents(df).collect()
        assert sum(r.length for r in pieces) == sum(len(x) for x in want) // 4
        assert sum(r.doc_tokens for r in pieces if r.start == 0) == sum(len(x) for x in want) // 4
        windows = {}
        for r in pieces:
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for w in windows.values():
            w.sort()
            assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:], strict=False)) and sum(w[-1]) <= 2048
        crcs = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces}
        for r in df.collect():
            ids = ids_of(tokenizer, r.text, 1)
            for a in range(0, len(ids), 2048):
                assert (r.doc_id, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) in crcs
    assert packing.pack_documents(empty).count() == 0


def test_packing_pads_little(spark, docs):
    pieces = packing.pack_documents(docs.coalesce(1)).collect()
    assert sum(r.length for r in pieces) >= 0.97 * 2048 * len({r.sequence_id for r in pieces})


# op7


def test_contaminated(spark, docs, odd, benchmark, empty, small):
    items = common.table(spark, small, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    text_of, item_of = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    assert got >= {(d, i) for d, t in text_of.items() for i, x in item_of.items() if x in t}
    words = {i: decontaminate._WORD.findall(x.lower()) for i, x in item_of.items()}
    for d, i in got:  # nothing is found that a whole alignment doesn't find
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words[i]))}
        doc = np.array([numbers.get(w, -1) for w in decontaminate._WORD.findall(text_of[d].lower())])
        assert decontaminate.smith_waterman(np.array([numbers[w] for w in words[i]]), doc)[0] >= 0.8 * len(words[i])
    parts = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, part_words=300).collect()}
    assert parts == got
    assert {r.doc_id for r in decontaminate.contaminated(odd, benchmark).collect()} == {4}
    assert decontaminate.contaminated(empty, benchmark).count() == 0 and decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 200 - len({d for d, _ in got})


def test_an_item_in_every_document_is_found(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(5)) for _ in range(400)]
    item = " ".join(rng.choices(words, k=30))
    docs = spark.createDataFrame([(k, " ".join([*rng.choices(words, k=40), *([item] if k % 2 else []), *rng.choices(words, k=40)])) for k in range(60)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 60, 2)) and all(r.score == 1.0 for r in got)


def test_half_copies_among_whole_ones_are_found(spark):
    """The n-grams that whole and half copies share are the more frequent ones of the item."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(2000)]
    item = rng.sample(words, 40)
    copies = {k: item if k < 50 else item[20:] if k < 54 else [] for k in range(100)}
    docs = spark.createDataFrame([(k, " ".join([*rng.choices(words, k=40), *x, *rng.choices(words, k=40)])) for k, x in copies.items()], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(54)) and all(r.score == 0.5 for r in got if r.doc_id >= 50)


def test_places_are_those_of_the_text_itself(spark):
    item = "Seven grey cats sat on the long wall and sang İstanbul songs until noon"
    text = f"İİ İ x İ {item.upper().replace('İSTANBUL', 'İstanbul')} the end"
    got = decontaminate.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert got.score == 1.0 and text[got.char_start : got.char_end].lower() == item.lower()


def test_rows_go_by_their_own_text(spark):
    item = " ".join(f"word{k}" for k in range(30))
    made = [(1, f"a b {item} c"), (1, "clean text of the same id"), (None, f"x {item}"), (None, "clean too"), (2, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for x in ("bad_id", "bad_hash", "a.b", "row", "own_id"):
        docs = docs.withColumn(x, F.lit("own"))
    got = decontaminate.drop_contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert got.columns == docs.columns and sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == sorted([made[1], made[3], made[4]], key=repr)


# op8


def brute_chunks(found, long_words=50):
    """Texts after removal; places are chosen with Spark's own hash, which is XXH64 with seed 42."""
    import struct
    from collections import Counter

    import xxhash

    def h(data, seed=42):
        x = xxhash.xxh64_intdigest(data, seed % 2**64)
        return x - 2**64 if x >> 63 else x

    def rolling(*values):  # Spark hashes columns one after the other, the last result as the seed
        seed = 42
        for form, v in values:
            seed = h(struct.pack(form, v), seed)
        return seed

    def split(text):
        lines = text.split("\n")
        solid = [k for k, x in enumerate(lines) if re.search(r"\S", x, re.A)]
        hashes = {k: h(lines[k].encode()) for k in solid}
        pairs = [(a, b - a + 1, rolling(("<q", hashes[a]), ("<q", hashes[b]), ("<i", b - a + 1))) for a, b in zip(solid, solid[1:], strict=False)]
        roll = [r for *_, r in pairs]
        chosen = [len(lines[a]) + len(lines[a + n - 1]) >= 2 * long_words or k in (0, len(pairs) - 1) or r <= max(roll[k - 1], roll[k + 1]) for k, (a, n, r) in enumerate(pairs)]
        singles = [(k, 1, rolling(("<q", hashes[k]), ("<i", 1))) for k in solid if len(re.split(r"[ \t\n\x0b\f\r]+", lines[k].strip(" "))) > long_words]
        return lines, pairs, chosen, singles

    rows = [x for x in found if x[1] is not None]
    count = Counter()
    for _, text in rows:
        _, pairs, chosen, singles = split(text)
        count.update(r for (*_, r), yes in zip(pairs, chosen, strict=True) if yes)
        count.update(r for *_, r in singles)
    seen, out = {}, {}
    for doc, text in set(rows):
        lines, pairs, chosen, singles = split(text)
        at = {k for k, (*_, r) in enumerate(pairs) if chosen[k] and count[r] > 1}
        at |= {k + d for k in at for d in (-1, 1) if 0 <= k + d < len(pairs)}
        out[doc, text] = [(a, n, "\n".join(lines[a : a + n])) for a, n, _ in [*(pairs[k] for k in at), *(x for x in singles if count[x[2]] > 1)]]
        for a, _, body in out[doc, text]:
            seen.setdefault(body, []).append((-(2**63) if doc is None else doc, h(text.encode()), a))
    for (doc, text), own in out.items():
        place = (-(2**63) if doc is None else doc, h(text.encode()))
        gone = {a + k for a, n, body in own if min(seen[body]) != (*place, a) for k in range(n)}
        out[doc, text] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def test_repeated_chunks_go(spark, docs, odd, empty):
    long_line = " ".join(f"w{k}" for k in range(60))
    made = [(1, f"a\n{long_line}\nb"), (2, f"c d\n{long_line}"), (2, f"c d\n{long_line}"), (3, f"{long_line}\n{long_line}"), (None, "p\nq\nr\ns\nt"), (5, "p\nq\nr\ns\nt"), (6, None), (7, "")]
    for df in (docs.select("doc_id", "text"), spark.createDataFrame(made, "doc_id long, text string")):
        found = [(r.doc_id, r.text) for r in df.collect()]
        want = brute_chunks(found)
        got = chunks.remove_repeated_chunks(df)
        assert got.columns == ["doc_id", "text", "removed_chunks", "removed_lines"]
        assert rows(got.select("doc_id", "text")) == sorted(((d, None if t is None else want[d, t]) for d, t in found), key=repr)
    left = chunks.remove_repeated_chunks(odd)
    assert left.count() == len(ODD) and left.where("removed_chunks > 0").count() == 0
    assert chunks.remove_repeated_chunks(empty).count() == 0


def test_chunks_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash that is the same for all, bytes decide."""
    made = spark.createDataFrame([(k, f"line {k % 3}\n{'word ' * 60}{k % 3}") for k in range(6)], "doc_id long, text string")
    plain = rows(chunks.remove_repeated_chunks(made))
    monkeypatch.setattr(chunks.F, "xxhash64", lambda *c, f=F.xxhash64: F.lit(1).cast("long") if len(c) > 1 else f(*c))
    assert rows(chunks.remove_repeated_chunks(made)) == plain


def test_line_dedup_is_native(spark, docs):
    plan = chunks.remove_repeated_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_repeated_passages_of_short_lines_go_wherever_they_stand(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(n))
    passages = [[line(n) for n in sizes] for sizes in ((20, 18, 17), (30, 25), (12, 3, 49, 2, 15, 40), (26, 25), (60,))]
    passages[2].insert(2, "")
    made, left = [], {}
    for k in range(20):
        before, after = [line(9) for _ in range(k % 4)], [line(11) for _ in range(k % 3)]
        made.append((k, "\n".join([*before, *passages[k % 5], *after])))
        left[k] = "\n".join([*before, *(passages[k % 5] if k < 5 else []), *after])
    got = chunks.remove_repeated_chunks(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == left
    assert all((r.removed_chunks > 0) == (r.removed_lines > 0) for r in got)
    text = "\n".join(["of a kind"] * 30)
    assert chunks.remove_repeated_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text.startswith("of a kind")


@pytest.mark.parametrize("size", [3, 4, 6, 10])
def test_repeated_blocks_go_in_foreign_surroundings(spark, size):
    rng = random.Random(size)
    line = lambda: " ".join("".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(rng.randint(2, 5)))
    blocks = [[line() for _ in range(size)] for _ in range(20)]
    around = {k: ([line() for _ in range(5)], [line() for _ in range(5)]) for k in range(200)}
    made = [(k, "\n".join([*a, *blocks[k % 20], *b])) for k, (a, b) in around.items()]
    left = {r.doc_id: r.text for r in chunks.remove_repeated_chunks(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert left == {k: "\n".join([*a, *(blocks[k % 20] if k < 20 else []), *b]) for k, (a, b) in around.items()}


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = " ".join(f"w{k}" for k in range(60))
    made = spark.createDataFrame([(1, line, 5), (2, f"{line}\nx", 6), (3, "y", 7)], "doc_id long, text string, n_chars int").withColumn("removed_chunks", F.lit(77))
    for x in ("a.b", "tick`", "row", "kept", "gone", "lines", "owner", "text_hash"):
        made = made.withColumn(x, F.lit("own"))
    got = chunks.dedup_lines(made)
    assert got.columns == made.columns and got.schema["n_chars"].dataType == made.schema["n_chars"].dataType
    assert rows(got)[1][:4] == (2, "x", 1, 77) and rows(got)[0] == rows(made)[0] and rows(got)[2] == rows(made)[2] and set(rows(got)[1][4:]) == {"own"}


# op9


def test_toxicity(spark, odd, empty, labels):
    rng = random.Random(5)
    calm = ["".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(300)]
    made = []
    for k in range(900):
        bad = k % 3 == 0
        made.append((k, " ".join([*rng.choices(calm, k=40), *(rng.sample(["grumbo", "snarkle", "bluntch", "vexoid"], 2) if bad else [])])))
    df = spark.createDataFrame(made, "doc_id long, text string")
    own = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, own).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.98 * len(held)
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {round(r.score, 6) for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


def test_toxicity_of_a_pair_whose_words_alone_tell_nothing(spark):
    """Label 1: exactly one of two words."""
    rng = random.Random(9)
    calm = ["".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(300)]
    made, own = [], []
    for k in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        made.append((k, " ".join([*rng.choices(calm, k=40), *(["grumbo"] if a else []), *(["vexoid"] if b else [])])))
        own.append((k, int(a != b)))
    got = toxicity.toxicity(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(own, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == own[r.doc_id][1] for r in held) >= 0.95 * len(held)


def test_repeated_rows_are_one_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "a b"), *[(2, "c d")] * 500, (3, "e")], "doc_id long, text string")
    own = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (3, 2)], "doc_id long, toxic int")
    sample, rate, prior = toxicity.labelled_sample(docs, own, 6000, 1 << 20)
    assert rows(sample.select("toxic", "text", "times")) == [(0, "c d", 500), (0, "e", 1), (1, "a b", 1)] and rate == {0: 1.0, 1: 1.0} and prior == 1.5 / 503


# the pipeline


def test_pipeline(spark, small, docs, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "decontamination", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        clash = odd
        for x in ("kept_id", "keep_id", "bad_id", "removed_chunks", "own_id", "a.b", "tick`", "best", "text_hash"):
            clash = clash.withColumn(x, F.lit("own"))
        for df in (clash, empty):
            got = stage(spark, df, small)
            assert k == 4 or got.dtypes == df.dtypes
            assert got.count() >= 0 if k == 4 else all(r["own_id"] == r["a.b"] == "own" for r in got.collect()) if df is clash else got.count() == 0
    pieces = corpus_pipeline.run(spark, small).collect()
    kept = {r.doc_id for r in pieces}
    assert 150 <= len(kept) <= 200 and all(sum(x.length for x in pieces if x.doc_id == d) == next(x.doc_tokens for x in pieces if x.doc_id == d) for d in list(kept)[:5])
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, common.table(spark, small, "benchmark")).collect()}
    parts = {d: c for d, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])}
    assert not kept & leaks and len({parts[d] for d in kept}) >= 0.95 * len({c for d, c in parts.items()}) - len(leaks)


def test_pipeline_like_brute_force(spark, small, docs):
    """All stages in plain Python: chunks by a dictionary, all pairs of fingerprints, alignment of all pairs of texts, ids by the library."""
    scored = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if scored[r.doc_id].lang_pred != "und" and scored[r.doc_id].score >= 0.3]
    texts = brute_chunks(left)
    left = [(d, texts[d, t]) for d, t in left]
    first = {d: c for d, _, c in brute_components(left)}
    left = [(d, t) for d, t in left if first[d] == d]
    items = [decontaminate._WORD.findall(r.text.lower()) for r in common.table(spark, small, "benchmark").collect()]

    def copied(text):
        words = decontaminate._WORD.findall(text.lower())
        for item in items:
            numbers = {w: k for k, w in enumerate(dict.fromkeys(item))}
            doc = np.array([numbers.get(w, -1) for w in words], np.int64)
            if decontaminate.smith_waterman(np.array([numbers[w] for w in item]), doc)[0] >= 0.4 * 2 * len(item):
                return True
        return False

    tokenizer = whole()
    want = {d: ids_of(tokenizer, t, 1) for d, t in left if not copied(t)}
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in pieces} == set(want)
    for r in pieces:
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs_and_gives_the_same_again(spark, small, name):
    if name == "op4_top_k":
        return
    f = queries.queries()[name]
    assert rows(f(spark, small)) == rows(f(spark, small)) != []
