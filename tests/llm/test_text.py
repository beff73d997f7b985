"""Parts of the operators that need no Spark."""

import random
import re

import numpy as np
import pytest

from lodespar.llm import decontaminate, html, language, packing, pii, rans, simhash, tokens, toxicity


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path())


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "Hello, world! It's 3.5% of 1000²\n\n  two  spaces\t\ttabs \r\n end ", "naïve café ñandú Ärger ½ ß", "日本語 text 🙂 and nbsp x", "x <|endoftext|> y", "''''s 'll'd", "a" * 5000, "_under_score-9__9", "\x00\x1c\x85 odd"],
)
def test_ids_equal_the_librarys(whole, text):
    got = np.frombuffer(tokens.encoder(tokens.public_path()).encode(text), tokens.ID).tolist()
    assert got == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts(whole):
    rng = random.Random(1)
    letters = "aeßñ Éz'st.,;:!?-_  \n\t\r()[]0123456789²½%$#&*\"<>|€漢"
    encode = tokens.Encoder(tokens.public_path(), memory=500).encode
    for _ in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        assert np.frombuffer(encode(text), tokens.ID).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_of_random_texts_together(whole):
    rng = random.Random(2)
    letters = "ab's.!9é   \n\n\t\r€"
    texts = ["".join(rng.choice(letters[: rng.randint(2, len(letters))]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for memory, at_once in ((10**6, 1 << 23), (200, 500), (0, 1)):
        found = tokens.Encoder(tokens.public_path(), memory).encode_all(texts, at_once)
        for text, ids in zip(texts, found, strict=True):
            assert np.frombuffer(ids, tokens.ID).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_remembered_pieces_stay_out_of_python(monkeypatch):
    """Packing's texts are mostly known pieces: no words of them become Python objects again."""
    encoder = tokens.Encoder(tokens.public_path())
    texts = [f"the {a}{b} of it.\nAnd {b}{a}, too" for a in "abcdefgh" for b in "ijklmnop"]
    want = list(encoder.encode_all(texts))
    held = []
    monkeypatch.setattr(encoder, "_ask", lambda pieces, joined: held.extend(pieces))
    assert list(encoder.encode_all(texts * 20)) == want * 20 and held == []
    assert len(encoder.known) == len(set(encoder.known.to_pylist())) <= 4 * 64 + 8


def test_new_pieces_are_asked_for_together(whole):
    """One call of the library for hundreds of pieces, also at the beginnings of lines, and none for those remembered."""
    asked = []

    class Counted:
        def encode(self, text, **options):
            asked.append(text)
            return whole.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    encoder = tokens.Encoder(tokens.public_path())
    encoder.tokenizer = Counted()
    text = "\n".join(f"{a}{b}{c}. And{c}{b}, {a}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz")
    want = whole.encode(text, add_special_tokens=False).ids
    for calls in (12, 0):
        asked.clear()
        assert np.frombuffer(encoder.encode(text), tokens.ID).tolist() == want
        assert len(asked) <= calls


@pytest.mark.parametrize("n", [0, 1, 15, 4096, 4097, 30_000])
@pytest.mark.parametrize("kind", ["skewed", "even", "one"])
def test_segments_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"skewed": lambda: rng.zipf(1.2, n) % 50_257, "even": lambda: rng.integers(0, 50_257, n), "one": lambda: np.full(n, 7)}[kind]().astype(tokens.ID)
    data = rans.encode_segment([None, -5, 2**40], [0, n // 3, n - n // 3], ids, before=12, part=3, segment=1)
    doc, sizes, back, before = rans.read_segment(data)
    assert doc == [None, -5, 2**40] and sizes.tolist() == [0, n // 3, n - n // 3] and before == 12 and (back == ids).all()
    if n > rans.BLOCK:
        assert (rans.read_segment(data, slice(1, 2))[2] == ids[rans.BLOCK : 2 * rans.BLOCK]).all()


@pytest.mark.parametrize("top", [300, 2**32 - 1])
def test_symbols_like_a_sort(top):
    ids = np.append(np.random.default_rng(top).integers(0, top, 5000), top).astype(tokens.ID)
    for got, want in zip(rans.symbols(ids), np.unique(ids, return_inverse=True, return_counts=True), strict=True):
        assert (got == want).all()
    data = rans.encode_segment([1], [len(ids)], ids)
    assert (rans.read_segment(data)[2] == ids).all()


def test_damage_is_seen():
    data = bytearray(rans.encode_segment([1], [9000], np.arange(9000, dtype=tokens.ID) % 300))
    data[-5] ^= 1
    with pytest.raises(rans.Corrupt):
        rans.read_segment(bytes(data))


def test_frequencies_sum_up():
    for counts in ([1], [1, 1, 1], [10**12, 1, 1], list(range(1, 50_001)), [1] * 65_536):
        got = rans.frequencies(np.array(counts))
        assert got.sum() == rans.SCALE and got.min() >= 1


def test_best_fit_decreasing_like_a_plain_search():
    rng = np.random.default_rng(3)
    for n in (1, 5, 400):
        lengths = rng.integers(1, 65, n)
        window, offset = packing.best_fit_decreasing(lengths, 64)
        left: list[int] = []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [(c, w) for w, c in enumerate(left) if c >= lengths[k]]
            if fits:
                left[min(fits)[1]] -= lengths[k]
            else:
                left.append(64 - lengths[k])
        assert window.max() + 1 == len(left)
        for w in range(window.max() + 1):
            own = sorted((int(offset[k]), int(lengths[k])) for k in np.flatnonzero(window == w))
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 64


def test_base_patterns_like_plain_ones():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    valid = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 13 <= len(d := re.sub(r"\D", "", x)) <= 19 and pii.luhn(d),
        "phone": lambda x: 9 <= len(re.sub(r"\D", "", x)) <= 15,
    }
    rng = random.Random(2)
    for k in range(6000):
        text = "".join(rng.choice(("a1.@-+ 9()0%b..@@12", "0123456789 -.+", "ab.@-%")[k % 3]) for _ in range(rng.randint(0, 50)))
        want = [(kind, *m.span()) for kind, p in plain.items() for m in re.finditer(p, text) if valid[kind](m.group())]
        assert [(x, a, b) for x, a, b, ok in pii.base_spans(text) if ok] == want, text
    assert not any(ok for *_, ok in pii.base_spans("1" * 50_000 + "@" + "." * 50_000))


def test_written_out_personal_data():
    base, voted = pii.candidates("mail joe (at) example (dot) com, call 555-123-4567, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32, token = \"ad9b9ab81594e97f2d82ac69ac6544142c4f1d40\"")
    assert base == [] and [x[0] for x in voted] == ["email", "phone", "ssn", "iban", "secret"] and all(x[3][0] == "+" for x in voted)


def test_reliabilities_follow_agreement():
    got = pii.reliabilities([("phone", "+++0+", 80), ("phone", "--0--", 60), ("phone", "+000+", 10)])
    assert got["phone", "+++0+"] > 0.9 > 0.1 > got["phone", "--0--"]


def test_fingerprint_bits_by_hand():
    import xxhash

    text = "A b  C\td\x0be Ä f"
    words = ["a", "b", "c", "d", "e", "Ä", "f"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash.fingerprint(text) % 2**64 == want
    assert simhash.fingerprint("One two") % 2**64 == xxhash.xxh64_intdigest(b"one two", 42) and simhash.fingerprint(" \n") == 0


def test_tile_links_connect_what_is_near():
    rng = np.random.default_rng(5)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for base in rng.integers(0, 2**63, 8, dtype=np.uint64)]))
    prints = prints[np.lexsort((prints, np.bitwise_count(prints)))]

    def groups(links, n):
        root = list(range(n))
        for a, b in links:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    near = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 4]
    links = simhash.tile_links(prints, len(prints), 4, step=16)
    assert groups(links, len(prints)) == groups(near, len(prints)) and len(links) < len(prints)


def test_alignment_by_hand():
    a = np.array([1, 2, 3, 4, 5])
    assert decontaminate.aligned(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (10, 1, 6)
    assert decontaminate.aligned(a, np.array([1, 2, 8, 4, 5]))[0] == 7  # one word changed
    assert decontaminate.aligned(a, np.array([1, 2, 4, 5]))[0] == 7  # one word missing
    assert decontaminate.aligned(a, np.array([-1, -1]))[0] == 0

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        assert decontaminate.smith_waterman(x, y)[0] == plain(x, y)


def test_edited_copies_are_found():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(60)]
    items = decontaminate.Items.of(rows, 3)
    items.choose()
    found = 0
    for k, text in rows:
        copy = [rng.choice(words) if rng.random() < 0.2 else w for w in text.split()]
        doc = " ".join([*rng.choices(words, k=200), *copy, *rng.choices(words, k=200)])
        found += [x[0] for x in items.matches(doc, 0.5)] == [k]
    assert found >= 57
    assert items.matches(" ".join(rng.choices(words, k=5000)), 0.5) == []


def test_folding_keeps_places():
    assert decontaminate.folded("ABC d") == "abc d" and decontaminate.folded("İxÄ Α") == "İxä α"
    assert all(len(decontaminate.folded(x)) == len(x) for x in ("İİİ İ", "ẞß", "".join(map(chr, range(1, 0x3000)))))


PAGE = """<html><head><title>T</title><script>var t="</p><p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=1>Menu</a></ul></nav><div class="cookie-notice">We use cookies, lots of them, really very many cookies.</div>
%s<h1>Title &amp; more</h1><p>First   paragraph of the <b>art</b>icle, which is long enough to count as such.<br>Next line.<p>Short.
<div class="ad">Buy now, buy cheap, buy a lot of this very nice thing today.</div><p>Last paragraph of the article, which is long enough too &lt;ok&gt;.</p>
<section id="comments"><p>I liked this article very much, thanks for writing it, my friend.</p></section>%s
<aside>Other things to read</aside><footer>&copy; me</footer></body></html>"""
TEXT = "Title & more First paragraph of the article, which is long enough to count as such. Next line. Short. Last paragraph of the article, which is long enough too <ok>."


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="c1">', "</div>"), ('<div class="with-sidebar wide"><div id="c">', "</div></div>")])
def test_main_text(tags):
    assert html.main_text(PAGE % tags) == TEXT


def test_main_text_of_odd_pages():
    assert [html.main_text(x) for x in ("", "plain", "<p>a<p>b &eacute;", "<script>x", "<nav>menu</nav>", "<article><p>cut off")] == ["", "plain", "a b é", "", "", "cut off"]
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


PARAGRAPHS = "".join(f"<p>Paragraph {k} of the article has words that go on and on for a while, so that its ratio of text to tags is a high one.</p>" for k in range(5))


def test_clustering_decides_inside_and_outside_declared_elements():
    links = "".join(f"<li><a href=/{k}>Another story number {k}</a></li>" for k in range(8))
    text = html.main_text(f"<body><article><h1>Head</h1>{PARAGRAPHS}<ul>{links}</ul>{PARAGRAPHS}<p>Short.</p></article></body>")
    assert "story number" not in text and text.startswith("Head") and text.endswith("Short.") and text.count("Paragraph") == 10
    text = html.main_text(f"<body><article><h2>Teaser</h2><p>A short teaser.</p></article><div><h1>Head</h1>{PARAGRAPHS}</div></body>")
    assert text.count("Paragraph") == 5 and "Head" in text


def test_content_outside_the_holding_element_stays():
    lead = "<div class=lead><p>The lead paragraph has eighty characters, or just about as many as it takes.</p></div>"
    text = html.main_text(f"<div>{lead}<div class=body>{PARAGRAPHS * 4}</div></div>")
    assert text.startswith("The lead paragraph") and text.count("Paragraph") == 20
    section = PARAGRAPHS[: PARAGRAPHS.index("</p>") + 4] * 2
    link = "<p><a href=x>A line that is nothing but one link to a source</a></p>"
    text = html.main_text(f"<div><div class=body>{PARAGRAPHS}<h2>Between</h2>{link}<p>Yes.</p>{PARAGRAPHS * 4}</div><div class=more>{section}</div></div>")
    assert text.count("Paragraph") == 27 and "Between A line that is nothing but one link to a source Yes." in text


@pytest.mark.parametrize(
    "page",
    [
        "<body><article class='post category-social tag-search'><h1>Head</h1>{}</article></body>",
        "<body><form action=x><input type=hidden value=y><nav>menu</nav><div><h1>Head</h1>{}<label>Name</label></div></form></body>",
        "<body><div class='page sidebar-left'><h1>Head</h1>{}<div class=sidebar><article><p>Teaser of another story.</p></article></div></div></body>",
        "<main><h1>Head</h1>{}<p>" + "".join(f"<a href={k}>link {k}</a> " for k in range(30)) + "</p></main>",
        "<main><h1>Head</h1>{}<div class=related><p><a href=1>Another story</a> and <a href=2>yet another</a></p></div></main>",
        "<article><h1>Head</h1>{}<form><p>Subscribe to our newsletter today.</p><input></form></article>",
        "<article><h1>Head</h1>{}</article><div id=comments><article class=comment-body>" + "<p>I think so too, and say it again and again.</p>" * 60 + "</article></div>",
    ],
)
def test_names_exclude_no_article(page):
    plain = " ".join(re.findall(r"<p>(.*?)</p>", PARAGRAPHS))
    assert html.main_text(page.format(PARAGRAPHS)) == f"Head {plain}"


def test_words_of_names():
    kinds = {"ad": html.APART, "cookieBanner": html.APART, "site_footer-2": html.APART, "ad1": html.APART, "commentList": html.COMMENTS, "post comments": html.COMMENTS, "postTags": html.LOOSE, "related": html.LOOSE}
    plain = ("", "article-body", "category-social", "tag-ads", "hasSidebar", "with-sidebar", "no_ads", "shadow", "header-image-free", "broadcast", "advice")
    assert {x: html.named(x, False) for x in kinds} == kinds and all(html.named(x, False) is None for x in plain)
    assert html.named("post ads sidebar", True) is None and html.named("comment-body", True) == html.COMMENTS


def test_related_work_is_part_of_the_article():
    text = html.main_text(f"<article><h1>Head</h1>{PARAGRAPHS}<section class='related work'><h2>Related work</h2>{PARAGRAPHS}</section></article>")
    assert text.count("Paragraph") == 10 and "Related work" in text


def test_short_article_beside_a_long_advert():
    assert html.main_text("<div class=ad>Buy this very nice thing today, and tomorrow too.</div><article><h1>Head</h1><p>Short.</p></article>") == "Head Short."


def test_clustering_like_a_plain_one():
    """Gaussian smoothing of every line by all others in reach, then two means about a threshold."""
    import math

    rng = random.Random(3)
    for n in (2, 3, 5, 9, 40):
        ratio = [rng.choice((3.0, 5.0, 80.0, 120.0)) for _ in range(n)]
        smooth = []
        for k in range(n):
            near = [(math.exp(-0.5 * d * d), ratio[k + d]) for d in range(-4, 5) if 0 <= k + d < n]
            smooth.append(math.log1p(sum(w * x for w, x in near) / sum(w for w, _ in near)))
        threshold = (min(smooth) + max(smooth)) / 2
        for _ in range(20):
            low, high = [x for x in smooth if x < threshold], [x for x in smooth if x >= threshold]
            if low and high:
                threshold = (sum(low) / len(low) + sum(high) / len(high)) / 2
        low, high = [x for x in smooth if x < threshold], [x for x in smooth if x >= threshold]
        apart = bool(low and high) and sum(high) / len(high) - sum(low) / len(low) >= 1
        assert html.content_lines(np.array(ratio)).tolist() == [not apart or x >= threshold for x in smooth]


def test_made_pages_give_back_their_articles():
    """A plain extractor knows what was put in: articles of any length among all that doesn't belong."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    links = lambda n: "".join(f"<li><a href=/{k}>{words(2)}</a></li>" for k in range(n))
    for k in range(60):
        blocks = [(rng.choice(("p", "p", "p", "h2", "blockquote")), words(rng.randint(3, 90))) for _ in range(rng.randint(3, 12))]
        body = "".join(f"<{t}>{x}" + rng.choice((f"</{t}>", f"</{t}>\n")) for t, x in blocks)
        noise = [f"<nav><ul>{links(6)}</ul></nav>", f"<div class='ad banner-{k}'>{words(30)}</div>", f"<aside>{words(20)}</aside>", f"<form><label>{words(2)}</label><p>{words(6)}</p><input></form>", f"<div class=cookie-notice>{words(12)}</div>", f"<script>{words(5)}</script>", f"<section id=comments><p>{words(80)}</p></section>"]
        rng.shuffle(noise)
        tag = rng.choice(("article", "main"))
        page = f"<html><body><header><p>{words(3)}</p></header>{''.join(noise[:3])}<{tag} class='{rng.choice(('', 'post', 'tag-ads entry'))}'><h1>{(head := words(5))}</h1>{body}{noise[3]}</{tag}>{''.join(noise[4:])}<footer>{words(9)}</footer></body></html>"
        assert html.main_text(page) == " ".join([head, *(x for _, x in blocks)])


def test_language_filters_have_all_languages():
    kept = [(language.grams(language.letters("abcdefgh ijkl"), 3), 1.0), (language.grams(language.letters("mnopqrst uvw abcd"), 3), 1.0)]
    filters = language.LanguageFilters.build(["x", "y"], (3,), kept)
    for l, (found, _) in enumerate(kept):
        assert all((filters.tables[0][filters.rows_of(found, k, len(filters.tables[0]))] >> l & 1).all() for k in range(3))
    assert filters.predict("bcdefg")[0] == "x" and filters.predict("nopqrs")[0] == "y"
    assert filters.predict("12 !")[:2] == ("und", 0.0) and 0 <= filters.predict("zzzzzz")[1] <= 1


def test_more_languages_than_one_mask_holds():
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k * 7 % 26)}" * 3 for k in range(150)]
    kept = [(language.grams(language.letters(x), 3), 1.0) for x in words]
    filters = language.LanguageFilters.build([f"l{k:03}" for k in range(150)], (3,), kept)
    assert len(filters.tables) == 3 and all(filters.predict(x)[0] == f"l{k:03}" for k, x in enumerate(words))


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows, label = [], []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append([k for k, yes in ((0, a), (1, b), (2, rng.random() < 0.5)) if yes])
        label.append(float(a and b))
    bias, w, v = toxicity.fit_machine(rows, np.array(label), np.ones(800), 3, epochs=600)
    machine = toxicity.FactorizationMachine({}, 8, bias, w, v)

    def score(at):
        x = machine.factor[at]
        raw = bias + w[at].sum() + 0.5 * ((x.sum(0) ** 2 - (x**2).sum(0)).sum())
        return 1 / (1 + np.exp(-raw))

    assert score([0, 1]) > 0.8 and score([0]) < 0.2 and score([1]) < 0.2 and score([]) < 0.2
    assert abs(v[0] @ v[1]) > abs(v[0] @ v[2])




def test_features_are_the_known_terms():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aei") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 300))) for _ in range(30)]
    every = sorted(set().union(*(toxicity.terms(x, 1 << 20) for x in texts)))
    place = {x: k for k, x in enumerate(rng.sample(every, len(every) // 3))}
    w, v = np.random.default_rng(0).normal(0, 0.1, len(place)), np.random.default_rng(1).normal(0, 0.1, (len(place), 3))
    machine = toxicity.FactorizationMachine(place, 1 << 20, -1.0, w, v, memory=50)
    for x in texts:
        at = sorted(place[t] for t in toxicity.terms(x, 1 << 20) if t in place)
        assert machine.features(x) == at
        raw = -1.0 + sum(w[k] for k in at) + sum(v[i] @ v[k] for n, k in enumerate(at) for i in at[:n])
        assert abs(machine.score(x) - 1 / (1 + np.exp(-raw))) < 1e-9


def test_levels_have_no_end():
    got = [toxicity.levels(n) for n in (1, 2, 16, 17, 32, 33, 64, 65, 2**40)]
    assert got == [1, 2, 16, 17, 17, 18, 18, 19, 52] and max(got) < toxicity.LEVELS


def test_blocks_of_rows_don_t_change_the_fit(monkeypatch):
    rng = np.random.default_rng(3)
    rows, label = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(50)], rng.integers(0, 2, 50).astype(float)
    one = toxicity.fit_machine(rows, label, np.ones(50), 6, epochs=20)
    monkeypatch.setattr(toxicity._Rows.__init__, "__defaults__", (42,))
    many = toxicity.fit_machine(rows, label, np.ones(50), 6, epochs=20)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(one, many, strict=True))


def test_pair_scores_like_plain_sums():
    rng = np.random.default_rng(4)
    rows = [sorted(set(rng.integers(0, 9, 4).tolist())) for _ in range(60)]
    error, spread = rng.normal(0, 0.4, 60), rng.uniform(0.1, 0.25, 60)
    first, column = np.cumsum([0, *map(len, rows)]), np.array([k for r in rows for k in r])
    z = np.zeros((12, 12))
    for i in range(9):
        for j in range(9):
            both = [k for k, r in enumerate(rows) if i in r and j in r and i != j]
            z[i, j] = abs(error[both].sum()) / np.sqrt(spread[both].sum() + 5 * spread.mean())
    for a in range(3):
        for b in range(a, 3):
            got = toxicity.pair_scores(first, column, error, spread, a, b, 4, 5)
            part = z[4 * a : 4 * a + 4, 4 * b : 4 * b + 4]
            assert np.allclose(got[0], part.max(1), atol=1e-4) and np.allclose(got[1], part.max(0), atol=1e-4)
