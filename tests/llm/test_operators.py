"""The training-data operators against brute force, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from pixelyard.llm import components, decontamination, html_pages, html_text, licenses, packing, quality, quality_rules, simhash, textvec, token_store, tokens, toxicity, url_filter
from pixelyard.llm.tokens import Encoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, VISIBLE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"
BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdeéüñ") for _ in range(RNG.randint(1, 6))) for _ in range(60)]


def prose(n: int, rng=RNG) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


PASSAGE = prose(14, random.Random(9))
SHOUTED = PASSAGE.translate(str.maketrans("abcde", "ABCDE"))
LONG = prose(60_000, random.Random(2))
TEXTS = [
    None,
    "",
    " \n\t ",
    "One",
    "two words",
    prose(30) + "\n" + SHOUTED + "\n" + prose(20),
    PASSAGE,
    prose(200) + ".\n" + prose(10),
    "a  b\t \n c  ",
    "Licensed under CC BY-NC 4.0.\n" + prose(5) + " gnu General\nPublic license, version 3",
    "\n".join([prose(12)] * 4),
    "x <|endoftext|> y's 12 Ⅷ İi é Σας",
    LONG,
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (7, TEXTS[7]), (None, PASSAGE), (None, None), (20, TEXTS[7] + " more"), (21, PASSAGE)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, w int, h int, rank int, part string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, f"src{(i or 0) % 2}", 1, "x", "y", 1, 2, 3, "z") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def test_word_vectors():
    column = pa.array(TEXTS)
    for pattern, kind in ((ALNUM, textvec.ALNUM), (VISIBLE, textvec.VISIBLE)):
        got = {}
        for w in textvec.words(column, kind):
            h = w.hashes()
            for d in range(w.last - w.first):
                own = range(w.begin[d], w.begin[d + 1])
                got[w.first + d] = [w.text(i).decode() for i in own]
                for i in own:
                    assert h[i] == h[next(j for j in own if w.text(j) == w.text(i))] if len(own) < 300 else True
        assert [got[i] for i in range(len(TEXTS))] == [words(t, pattern) for t in TEXTS]


# ------------------------------------------------------------------------ 1

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><div class="cookie-notice">We use cookies, accept them all.</div>
<article><h1>A  title</h1><p>First &amp; foremost,\n a paragraph.<p>Second<br>one &lt;b&gt; &eacute;&#33;<div class="ad">Buy this thing now, it is cheap.</div><p>Third, unclosed</article>
<div id="comments"><p>Great post, I liked it.</p></div><footer>&copy; someone</footer></body></html>"""


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE[: PAGE.index("Third") + 3]), (1, "u", PAGE), (5, "u", "just text")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert out[1]["text"] == "A title\n\nFirst & foremost, a paragraph.\n\nSecond one <b> é!\n\nThird, unclosed"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == out[3]["text"] == "" and out[2]["n_chars"] == 0
    assert out[4]["text"].endswith("Thi") and html_text.extract(pages).count() == 6
    assert html_text.extract(pages.where("false")).count() == 0


ARTICLE = "<article><h1>A title</h1><p>First, a paragraph of the article.</p><p>Second, some more text.</p></article>"
KEPT = "A title\n\nFirst, a paragraph of the article.\n\nSecond, some more text."


def test_html_elements_that_do_not_end():
    model = html_text.train(html_pages.labelled())
    text = lambda body: html_text.main_text(f"<html><body>{body}</body></html>", model)
    assert text(ARTICLE) == KEPT
    closed = "<svg><title>Icon</title><path d='M0 0'/></svg>"
    for start in ('<svg class="i"/>', "<svg/>", "<math/>", '<svg viewBox="0 0 1 1" />', "<svg class=i/>", "<svg>", "<svg><path d='M0 0'/>", "<object>", '<object data="x.swf">', "<select name=a>", "<template>", "<math>", "<svg><svg/>"):
        for after in ("", closed, "<select><option>one</select>" if "select" in start else closed):
            assert text(f"<header>{start}</header>{ARTICLE}{after}") == KEPT, (start, after)
            assert text(f"{start}{ARTICLE}{after}") == KEPT, (start, after)
    # closed ones go, also nested ones
    for start in (closed, f"<svg><g>{closed}<text>x</text></g></svg>", "<svg><foreignObject><div>label</div></foreignObject></svg>", "<select><option>one<option>two</select>", "<template><template><p>x</template><p>y, not shown.</p></template>", "<template><script>'</template>'</script><p>y, not shown.</p></template>"):
        assert text(f"{start}{ARTICLE}") == text(f"{ARTICLE}{start}") == KEPT
    inner = "<p>First, <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><p>Second, <object data=a><param name=b>a fallback</object> text.</p>"
    assert text(f"<article><h1>A title</h1>{inner}</article>") == "A title\n\nFirst, x=1 holds.\n\nSecond, a fallback text."
    assert len(html_text.parse("<svg>" * 20_000).tag) == len(html_text.parse("<template>" * 3).tag) - 3 == 1


def test_html_marginals_are_exact():
    model = html_text.train(html_pages.labelled(2))
    page = html_text.parse("<div class=menu><ul><li><a>x</a><li>y.</ul></div><main><p>Some text, here.</main>")
    got = model.marginals(page)
    n = len(page.tag)
    own = [sum(model.seen.get(x, 0.0) for x in seen) for seen in html_text._observed(page)]
    own[0] += model.root
    total, hit = 0.0, [0.0] * n
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        weight = np.exp(sum(own[i] for i in range(n) if y[i]) + sum(model.edge[page.tag[i] in html_text.HOLDERS][y[page.parent[i]]][y[i]] for i in range(1, n)))
        total += weight
        for i in range(n):
            hit[i] += weight * y[i]
    assert got == pytest.approx([x / total for x in hit], abs=1e-9)


def wrong_blocks(model, pages):
    wrong = total = 0
    for source in pages:
        page = html_text.parse(source)
        marginal = model.marginals(page)
        wrong += sum((marginal[node] > 0.5) != page.marked[node] for node, _, _ in page.blocks)
        total += len(page.blocks)
    return wrong, total


def test_html_layouts_that_are_left_out():
    """Layouts that are not among those learned from, every fourth at a time."""
    every, wrong, total = list(dict.fromkeys(html_pages.PAGES)), 0, 0
    for k in range(4):
        left = tuple(every[k::4])
        model = html_text.train(html_pages.labelled(6, layouts=tuple(x for x in html_pages.PAGES if x not in left)))
        w, n = wrong_blocks(model, html_pages.labelled(6, seed=3, layouts=left))
        wrong, total = wrong + w, total + n
    assert wrong < 0.05 * total
    w, n = wrong_blocks(html_text.train(html_pages.labelled()), html_pages.labelled(4, seed=77))
    assert w < 0.02 * n


def test_html_pages_of_little_markup_and_comments():
    model = html_text.train(html_pages.labelled())
    text, talk = "The article text goes here, with a full sentence in it.", "I like this very much, thanks."
    for page in (f"<body><p>{text}</p></body>", f"<p>{text}", f"<div>{text}</div>", text, f"<html><body><div class=zz><p>{text}</p></div></body></html>"):
        assert html_text.main_text(page, model) == text
    for comments in (f'<ol class="comment-list"><li>{talk}</li><li>Me too.</li></ol>', f'<ol class="comment-list"><li><p>{talk}</p></li></ol>', f'<section id="comments"><h2>Replies</h2><p>{talk}</p></section>', f'<div class="comments"><div class="comment"><p>{talk}</p></div></div>'):
        assert html_text.main_text(f"<article><p>{text}</p>{comments}</article>", model) == text
        assert html_text.main_text(f'<article><div class="qx">{f"<p>{text}</p>" * 2}</div>{comments}</article>', model) == f"{text}\n\n{text}"


def test_html_parsing_takes_time_by_length():
    import time

    def took(n):
        start = time.perf_counter()
        for page in ("<blockquote>" * n + "<li>x" * n, "<ul><li><ul>" + "<blockquote>" * n + "<li>x</li>" * n, "<iframe>" * n, "<noscript>" * n, "<table><tr><td>" * n, "<p>" * n):
            html_text.parse(page)
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 40 * took(2_000) ** 1.0 + 1.0


# ------------------------------------------------------------------- 2 and 8


def labelled(spark, n=600):
    rng, rude, out, marks = random.Random(1), ["blargh", "zounds"], [], []
    for i in range(n):
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        body = [rng.choice(VOCAB) for _ in range(rng.randint(20, 60))]
        if toxic:
            body.insert(rng.randrange(20), rng.choice(rude))
        text = " ".join(body) if good else " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in body)
        out.append((i, text, "en", "s", 1))
        marks.append((i, int(good), int(toxic)))
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, docs, empty, module, label):
    table, labels = labelled(spark)
    out = module.judged(table, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) > 0.9 * len(held)
    # labels of held-out rows are never read
    from pyspark.sql import functions as F

    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    assert sorted((r["doc_id"], r["score"]) for r in module.judged(table, flipped).collect()) == sorted((r["doc_id"], r["score"]) for r in out)
    model = module.fit(table, labels)
    assert len(module.judged(docs, labels).collect()) == len(DOCS)
    assert module.keep(docs, model).columns == docs.columns and module.judged(empty, labels).count() == 0
    assert module.score(docs, model).where("score is null").count() == 0
    assert 0 <= module.judged(docs, labels.where("false")).first()["score"] <= 1


def test_quality_learns_what_follows_a_clean_opening():
    rng = random.Random(8)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    noise = ["".join(rng.choice("klmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]

    def text(bad):
        opening = " ".join(rng.choice(clean) for _ in range(200))
        return f"{opening} {' '.join(rng.choice(noise if bad else clean) for _ in range(200))}"

    pairs = [(text(i % 2), 1 - i % 2) for i in range(1600)]
    model = quality.learn(pairs)
    # the words of the bad parts are in the dictionary, as are those of many good texts
    assert sum(w.encode() in model.bad for w in noise) > 0.9 * len(noise) and not any(w.encode() in model.good for w in noise)
    assert len(model.good) == len(model.bad) == quality.DICTIONARY
    assert quality.learn(pairs).bad == model.bad
    held = [(text(i % 2), 1 - i % 2) for i in range(100)]
    wrong = sum((s >= quality.THRESHOLD) != y for s, (_, y) in zip(model.scores(pa.array([t for t, _ in held])), held, strict=True))
    assert wrong < 5
    # few texts are learned whole
    assert quality._dictionary([t.encode() for t, _ in pairs[:20]]) == "\n".join(t for t, _ in pairs[:20]).encode()


def plain_features(text):
    """The keys of a text, as a set: words, heads, neighbours and pairs with gaps, by their own plain names."""
    w = words(text, ALNUM)
    out = {("word", x) for x in w} | {("head", x.encode()[: toxicity.HEAD]) for x in w}
    return out | {(gap, w[i], w[i + gap]) for gap in (1, 2, 3) for i in range(len(w) - gap)}


def test_features_are_those_of_the_words():
    """Each bucket stands for one plain key (or, rarely, several), in every text alike."""
    texts = [*TEXTS[:12], LONG[:3000], "a b", "B A", "a"]
    names: dict = {}
    for text in texts:
        got = set()
        for w in textvec.words(pa.array([text], pa.string())):
            got |= set(toxicity.features(w)[1].tolist())
        own = plain_features(text)
        assert len(own) * 0.99 <= len(got) <= len(own)
        for key in own:
            names.setdefault(key, set(got)).intersection_update(got)
    assert all(names.values())  # a key has a bucket that all of its texts have


def test_ftrl_against_a_plain_loop():
    """Per-coordinate rates and the L1 term, a coordinate at a time in a dictionary."""
    rng = random.Random(3)
    pairs = [(" ".join(rng.choice(VOCAB[:25]) for _ in range(rng.randint(0, 9))) + (" blargh" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    sets = []
    for text, _ in pairs:
        for w in textvec.words(pa.array([text])):
            sets.append({0, *toxicity.features(w)[1].tolist()})
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        sign = 1.0 if z[i] > 0 else -1.0
        return 0.0 if abs(z[i]) <= toxicity.L1 else (sign * toxicity.L1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(sets)).tolist():
            p = 1 / (1 + np.exp(-sum(weight(i) for i in sets[k])))
            g = p - pairs[k][1]
            for i in sets[k]:
                w = weight(i)
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i], n[i] = z[i] + g - sigma * w, n[i] + g * g
    expected = {i: w for i in set(z) if (w := weight(i))}
    model = toxicity.learn(pairs)
    assert dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(expected, rel=1e-5)
    scores = model.scores(pa.array([t for t, _ in pairs]), model.table())
    assert scores == pytest.approx([1 / (1 + np.exp(-sum(expected.get(i, 0.0) for i in s))) for s in sets], rel=1e-5)
    assert ((scores >= 0.5) == [y for _, y in pairs]).all()


def test_compression_scores_against_the_library():
    """The blocks' sizes from the library, a block at a time; the curve rises and meets the labels' shares."""
    import zstandard

    rng = random.Random(4)
    pairs = [((prose(60, rng) if i % 4 else " ".join(["spam"] * rng.randint(20, 60))), int(i % 4 > 0)) for i in range(400)]
    model = quality.learn(pairs)

    def size(raw, block):
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(block))

    for text in (pairs[0][0], pairs[1][0], "x", "", None, prose(300, rng)):
        raw = (text or "").encode()
        blocks = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        differences = sorted((size(model.bad, b) - size(model.good, b)) / max(size(model.bad, b), size(model.good, b)) for b in blocks) or [0.0]
        expected = np.interp(differences[int(quality.SHARE * (len(differences) - 1))], *model.curve)
        assert model.scores(pa.array([text], pa.string()))[0] == pytest.approx(expected, abs=0.02)
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 1.0])
    at, level = quality.calibrate(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all() and np.interp(0.25, at, level) == pytest.approx(0.5, abs=0.03)
    assert quality.calibrate(x, np.ones(6))[1] == pytest.approx([7 / 8])


def test_samples_are_bounded_in_bytes_and_count_a_doc_id_once(spark):
    from pixelyard.llm.common import learned

    rows = [(i, f"{i:04d}" * 25) for i in range(300)] + [(7, "zzz"), (9, None), (None, "x" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 1), (None, 1)], "doc_id long, toxic int")
    every = learned(docs, labels, "toxic", 1000, lambda pairs: pairs)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)) and ("zzz", 1) not in every
    few = learned(docs, labels, "toxic", 1000, lambda pairs: pairs, most_bytes=1000)
    assert few[:9] == every[:9] and set(few) < set(every) and 900 <= sum(len(t) for t, _ in few) <= 1000  # one that doesn't fit is left out whole
    assert learned(docs, labels.where("false"), "toxic", 10, lambda pairs: pairs) == []


def test_ftrl_is_sparse(spark):
    table, labels = labelled(spark)
    model = toxicity.fit(table, labels)
    assert 0 < len(model.buckets) < 3000


# ------------------------------------------------------------------------ 3


def fingerprint(text):
    w = words(text, VISIBLE)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], dtype=np.uint64)
    return sum(int(2 * np.count_nonzero(h >> np.uint64(b) & np.uint64(1)) > len(h)) << b for b in range(64))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    prints = [fingerprint(t) for _, t in DOCS]
    found = brute_components(prints)
    least = {}
    for (i, _), c in zip(DOCS, found, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    expected = sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(DOCS, prints, found, strict=True)), key=key)
    assert sorted((tuple(r) for r in out), key=key) == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"],) for r in kept.collect()), key=key) == sorted(((x,) for x in {c: c for _, _, c in expected}), key=key)


def test_one_of_each_keeps_different_texts(spark):
    """Texts of one doc_id, texts without one, and copies of both."""
    a, b, c, d = (prose(60, random.Random(i)) for i in range(4))
    rows = [(3, a), (7, a), (7, b), (7, b), (None, c), (None, c), (None, d), (9, d), (None, None), (None, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=key) == sorted([(3, a), (7, b), (None, c), (9, d), (None, "")], key=key)


def test_links_lose_no_pair(spark):
    """Crowded meetings (more fingerprints than are paired) and sparse ones."""
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for seed in [rng.getrandbits(64) for _ in range(4)] + list(prints)[:30]:
        for _ in range(40 if rng.random() < 0.2 else 3):
            seed ^= 1 << rng.randrange(64)
            prints.add(seed)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(table)
    pairs = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    pairs = {(min(p), max(p)) for p in pairs}
    assert {tuple(r) for r in edges.collect()} == pairs
    # meetings are parted as far as it goes, and no pair is lost
    assert {tuple(r) for r in simhash.links(table, paired=1).collect()} == pairs
    assert all((a ^ b & (1 << 64) - 1).bit_count() <= 2 or ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges.collect())
    root = {r["node"]: r["root"] for r in components.components(edges).collect()}
    got = [root.get(p, p) for p in signed]
    assert len(set(zip(got, brute_components(prints), strict=True))) == len(set(got)) == len(set(brute_components(prints)))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (502, 502)]
    out = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert out == {i: 0 for i in range(1, 201)} | {501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------ 4


def test_url_filter(spark):
    urls = ["http://a.example.org/es/x", "HTTPS://EXAMPLE.ORG/en/12?q#f", "http://example.org/en/2", "http://notexample.org/es/", "http://org/", "http://org", "x://b.com/fr/", "http://b.com/de/?x", "http://b.com/", "http://evil.net/x.org/", None, "no scheme", "://", "http://h.net/p#a://b", "http://spam-farm.net/", "http://h.net/a.exe", "http://h.net/a/wp-login.php", "http://é.org/ü" + "y" * 9000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [out[i]["rule"] for i in range(len(urls))] == ["example.org/es/", "example.org/en/1", "org/", "org/", "org/", None, "com/fr/", "com/de/", None, None, None, None, None, None, None, None, None, "org/"]
    assert [out[i]["verdict"] for i in range(10, 17)] == ["block"] * 3 + ["allow"] + ["block"] * 3
    assert (out[1]["host"], out[1]["path"], out[10]["host"]) == ("example.org", "/en/12", "") and url_filter.judge(pages).count() == len(urls) + 1


def test_url_filter_equals_its_sql(spark):
    import duckdb

    from pixelyard.llm import sql

    rng = random.Random(5)
    hosts = ["a.com", "B.example.org", "user:pw@x.ads.net:8080", "spam-farm.net.", "m.casino-win.net:443", "casino-win.net", "h.net", "", "[::1]:80", "x@cheap-pills.com..", "t.tracking.io"]
    paths = ["", "/", "/de/x", "/fr/", "/en/12", "/es/", "/wp-login.php", "/a/%77p-login.php", "/%63gi-bin/x", "/a/b/cgi-bin/", "/x.%65xe", "/x.e%78E", "/a%2Fwp-login.php", "/y.apk", "/é.exe"]
    urls = [f"{rng.choice(('http', 'HTTPS', ''))}://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/x.exe", "#b")] + [None, "", "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    columns = ["page_id", "host", "path", "rule", "verdict"]
    theirs = con.sql(sql.URL_FILTER).df()[columns].sort_values("page_id")
    ours = url_filter.judge(pages).toPandas()[columns].sort_values("page_id")
    assert ours.astype(str).replace("nan", "None").values.tolist() == theirs.astype(str).replace("nan", "None").values.tolist()
    assert {tuple(x) for x in ours[["rule", "verdict"]].astype(str).values.tolist()} >= {("None", "block"), ("None", "allow")}
    assert url_filter.canonical("u@h.net:80", "/%2541%41%%341") == ".h.net/%2541AA"


def glob_matches(glob: str, text: bytes) -> bool:
    parts = {url_filter.STAR: b"[^/]*", url_filter.STARS: b".*", url_filter.ONE: b"."}
    return re.fullmatch(b"".join(parts[x] if x in parts else re.escape(bytes([x])) for x in url_filter.parse(glob)), text, re.S) is not None


def test_globs_against_regular_expressions():
    rng = random.Random(3)
    globs = [g for g in ("".join(rng.choice(["a", "b", "/", "*", "**", "?", "ab"]) for _ in range(rng.randint(1, 30))) for _ in range(60)) if g.strip("*")]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    hits = url_filter.Automaton([url_filter.Rule(g, "block") for g in globs]).matches(pa.array(texts))
    for i, t in enumerate(texts):
        assert hits[i].tolist() == [glob_matches(g, t.encode()) for g in globs]


# ------------------------------------------------------------------------ 5


def brute_contamination(docs, items):
    known = {}
    for item, text in items:
        w = words(text, ALNUM)
        if item is not None:
            for i in range(max(1, len(w) - 9) if w else 0):
                known.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w = words(text, ALNUM)
        hit, found = set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=key)


def test_decontamination(spark, docs, empty):
    items = [(1, PASSAGE), (10, PASSAGE + " " + prose(8)), (2, "two words"), (3, ""), (4, None), (None, prose(20)), (1, prose(12))]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, lang string")
    expected = brute_contamination(DOCS, items)
    assert sorted(rows(decontamination.report(docs, bench)), key=key) == expected
    for blocks in (1, 7):
        found = decontamination.contamination(docs, bench, block_rows=blocks).collect()
        assert sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) for r in found), key=key) == [r[:4] for r in expected]
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(((r["doc_id"],) for r in kept.collect()), key=key) == [(r[0],) for r in expected if not r[5]]
    cut = {r["doc_id"]: r["text"] for r in decontamination.clean(docs, bench, cut=True).collect()}
    assert cut[6] == "" and SHOUTED not in cut[5] and cut[5].startswith(TEXTS[5][:20]) and cut[7] == TEXTS[7]
    assert decontamination.report(empty, bench).count() == 0
    # however many blocks the windows are cut into, the same words go
    whole = sorted(rows(decontamination.clean(docs, bench, cut=True).select("doc_id", "text")), key=key)
    for blocks in (2, 5):
        assert sorted(rows(decontamination.clean(docs, bench, cut=True, block_rows=blocks).select("doc_id", "text")), key=key) == whole
        assert decontamination.clean(docs, bench, block_rows=blocks).count() == kept.count()
    run = " ".join(f"w{i}" for i in range(30))
    one = docs.sparkSession.createDataFrame([(1, f"pre {run} post", 5)], "doc_id long, text string, spans int")
    item = docs.sparkSession.createDataFrame([(1, run)], "item_id long, text string")
    for blocks in (1_000_000, 5, 2):
        assert rows(decontamination.clean(one, item, cut=True, block_rows=blocks)) == [(1, "pre  post", 5)]
    assert decontamination.report(docs, bench.where("false")).where("contaminated").count() == 0


# ------------------------------------------------------------------------ 6


def test_quality_rules(spark, docs, empty):
    out = quality_rules.judge(docs).collect()
    expected = []
    for doc_id, t in DOCS:
        t = t or ""
        w = re.findall(VISIBLE, t)
        lines = [x for x in t.split("\n") if re.search(VISIBLE, x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times = collections.Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
        expected.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert sorted((tuple(r[:7]) for r in out), key=key) == sorted(expected, key=key)
    assert all(not r["kept"] for r in out if r["base_failed"]) and quality_rules.judge(empty).count() == 0


def brute_mcd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance by the operator's description, in numpy."""
    n, tolerance = x.shape[1], quality_rules.TOLERANCE * np.eye(x.shape[1])
    half = lambda a, d: np.quantile(np.round(a, d), 0.5, axis=0)
    middle = half(x, 3)
    away = np.sqrt((1.4826 * half(np.abs(x - middle), 3)) ** 2 + quality_rules.TOLERANCE)
    squashed = np.tanh((x - middle) / away)
    ties = np.eye(n)
    for i in range(n):
        for j in range(i):
            if squashed[:, i].std() * squashed[:, j].std() > 1e-12:
                ties[i, j] = ties[j, i] = np.corrcoef(squashed[:, i], squashed[:, j])[0, 1]

    def log_distance(m, c):
        return np.round(np.log(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + 1e-9), 2)

    def step(m, c):
        d = log_distance(m, c)
        inner = x[d <= np.quantile(d, quality_rules.KEPT_SHARE) + 1e-6]
        return inner.mean(axis=0), quality_rules.CONSISTENT * np.cov(inner.T, bias=True) + tolerance

    found = []
    for m, c in ((middle, np.diag(away**2)), (x.mean(axis=0), np.cov(x.T, bias=True) + tolerance), (middle, ties * np.outer(away, away))):
        for _ in range(quality_rules.FIRST_STEPS):
            m, c = step(m, c)
        found.append((np.round(np.linalg.slogdet(c)[1], 6), len(found), m, c))
    _, _, m, c = min(found, key=lambda f: f[:2])
    for _ in range(100):
        before = np.linalg.slogdet(c)[1]
        m, c = step(m, c)
        if before - np.linalg.slogdet(c)[1] <= quality_rules.SETTLED:
            return m, c
    raise AssertionError("not settled")


def test_outliers_against_numpy(spark):
    rng = random.Random(12)
    texts = []
    for i in range(900):
        w = [rng.choice(VOCAB) for _ in range(rng.randint(20, 80))]
        if i % 3:
            w = [x.capitalize() if rng.random() < 0.3 else x for x in w]
        if i % 5 == 0:
            w = [x + "#" * rng.randint(0, 3) for x in w]
        if i % 97 == 0:
            w = [x * rng.randint(1, 6) for x in w]
        texts.append((i, " ".join(w), ("en", "fr", None)[i % 3], f"s{i % 2}" if i % 10 else f"rare{i % 7}"))
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(table).collect()}
    vectors = {r["doc_id"]: [r[c] for c in quality_rules.VECTOR] for r in quality_rules._vector(quality_rules.counts(table)).collect()}
    good = [t for t in texts if not got[t[0]]["base_failed"]]
    both, language = collections.Counter((t[2], t[3]) for t in good), collections.Counter(t[2] for t in good)
    wide = {k for k, n in both.items() if n < quality_rules.LEAST}
    assert len(both) > len(wide) > 0
    known = {}
    for key in both:
        rows = [t for t in good if (t[2], t[3]) == key] if key not in wide else [t for t in good if t[2] == key[0]] if language[key[0]] >= quality_rules.LEAST else good
        known[key] = brute_mcd(np.array([vectors[t[0]] for t in rows]))
    gone = 0
    for doc_id, _, lang, source in good:
        m, c = known[lang, source]
        x = np.array(vectors[doc_id]) - m
        d = float(x @ np.linalg.inv(c) @ x)
        assert got[doc_id]["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert got[doc_id]["kept"] == (d <= quality_rules.CUTOFF)
        gone += d > quality_rules.CUTOFF
    assert 0 < gone < 300


def test_chi_square_figures():
    sample = np.random.default_rng(3).normal(size=(400_000, 4))
    d = (sample**2).sum(axis=1)
    assert quality_rules._over(9.0, 2) == pytest.approx((d > 9).mean(), abs=2e-3)
    inner = sample[d <= np.quantile(d, quality_rules.KEPT_SHARE)]
    assert quality_rules.CONSISTENT * inner.var(axis=0) == pytest.approx(np.ones(4), abs=0.02)


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash of one value every window meets every other; the words still decide."""
    from pyspark.sql import functions as F

    text = prose(40) + " " + " ".join(["once more the same eight words stand here"] * 2)
    table = spark.createDataFrame([(1, text), (2, prose(60))], "doc_id long, text string")
    whole = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.counts(table).collect()}
    monkeypatch.setattr(quality_rules, "_runs", lambda out: out.withColumn("h", F.transform(F.slice("h", 1, F.size("h") - 7), lambda x: F.lit(7).cast("long"))))
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.counts(table).collect()} == whole and whole[1] == 16


def test_outliers_go_and_the_rest_stays(spark):
    table, labels = labelled(spark)
    out = quality_rules.judge(table).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] for r in out if r["quality"]) > 0.97 * sum(r["quality"] for r in out)
    # three tenths of the rows are noise: the estimate stands on the other rows
    assert sum(r["kept"] for r in out if not r["quality"]) < 0.1 * sum(1 - r["quality"] for r in out)


# ------------------------------------------------------------------- 7 and 9


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_whole_text(path):
    whole, ours = Tokenizer.from_file(path), Encoder(path)
    odd = [*TEXTS[:-1], "a\n", "\n", "\na", " a", "a ", "x\n\ny", "\0a b\0", "<|STARTOFTEXT|> Word,!! it's", "a\x85 b\xa0\xa0c\u3000", "\x1c a\x1cb", "don't  Stop\n\n\n ÀÉ 12345", LONG[:5000]]
    for batch in (odd, odd[::-1]):
        for text, ids in zip(batch, ours.encode(pa.array(batch, pa.string())), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_odd_strings(path):
    """100,000 strings of letters that change in lower case, marks, white space, escapes and special tokens."""
    rng = random.Random(11)
    pools = ["abcdeXYZ", "éüñßÉÀÇÿŸıĳŉſƀǅȠªº²¼", "İi̇ı\u0300\u0301\u0308", "  \n\t\r\x0b\x85\xa0\u2003\u3000", "!#$%&*+,-./:;=?@|~)('\"<>_^`{}[]", "0123456789①Ⅷ", "漢字かな한글ΣςΩΆя", "\x00\x1c\x01\x7f\x80\xad\u200d", "😀👩"]
    special = ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "don't", "<|", "|>", "\n\n", "  ", "İ."]

    def odd():
        kinds = [*rng.sample(pools, rng.randint(1, 3)), "ab ", "e\n"]
        if rng.random() < 0.7:
            kinds = [k for k in kinds if max(k) < "\u0250"] or ["ab"]
        return "".join(rng.choice(special) if rng.random() < 0.05 else rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 20)))

    whole, ours = Tokenizer.from_file(path), Encoder(path)
    for _ in range(20):
        texts = [odd() for _ in range(5000)]
        for text, ids, expected in zip(texts, ours.encode(pa.array(texts)), whole.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == expected.ids, text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_keeps_the_words_that_most_texts_have(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_KEYS", 400)
    monkeypatch.setattr(tokens, "KEPT_KEYS", 200)
    rng = random.Random(12)
    whole, ours = Tokenizer.from_file(path), Encoder(path)
    asked, key = [], ours._key
    monkeypatch.setattr(ours, "_key", lambda x: asked.append(x) or key(x))
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(9))
    common = [word() for _ in range(50)]
    for part in range(12):
        known = common if part else []  # the first keys are not the common ones
        words = [*(word() for _ in range(150)), *known, *(x + ".," for x in known)]
        text = "1 " + " ".join(rng.sample(words, len(words)))
        assert np.frombuffer(ours.encode(pa.array([text]))[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert [asked.count(x) for x in common] == [1] * 50


def encoded(path, end):
    t = Tokenizer.from_file(path)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes() for _, x in DOCS]


def test_token_store(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(docs, path, BYTE, 2)
    out = token_store.read(spark, path).collect()
    expected = sorted(((i, ids) for (i, _), ids in zip(DOCS, encoded(BYTE, 2), strict=True)), key=key)
    got = sorted(((r["doc_id"], bytes(r["ids"])) for r in out), key=key)
    assert got == expected
    assert all(r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in out)
    ordered = sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in out), key=lambda x: (x is not None, x))
    assert [r["start"] for r in ordered] == np.append(0, np.cumsum([r["n_tokens"] for r in ordered])[:-1]).tolist()
    # repeated texts are stored once
    stored = spark.read.parquet(f"{path}/recipes").where("doc_id = 7").collect()
    assert sum(len(r["ids"]) > 0 for r in stored) == 1
    token_store.write(empty, path + "0", BYTE, 2)
    assert token_store.read(spark, path + "0").count() == 0


def test_a_damaged_store_is_refused(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    token_store.write(docs, f"file://{tmp_path}/a", BYTE, 2)
    flipped = spark.read.parquet(f"file://{tmp_path}/a/recipes").withColumn("ids", F.when(F.col("doc_id") == 5, F.concat(F.unhex(F.lit("FFFF")), F.substring("ids", 3, 1 << 20))).otherwise(F.col("ids")))
    flipped.write.parquet(f"file://{tmp_path}/b/recipes")
    spark.read.parquet(f"file://{tmp_path}/a/manifest").write.parquet(f"file://{tmp_path}/b/manifest")
    with pytest.raises(Exception, match="do not give its root"):
        token_store.read(spark, f"file://{tmp_path}/b").collect()


@pytest.mark.parametrize(("table", "lost"), [("recipes", "doc_id = 5"), ("recipes", "part = 0"), ("manifest", "part = 0"), ("manifest", "part = -1"), ("both", "part = 0")])
def test_a_store_with_missing_rows_is_refused(spark, docs, tmp_path, table, lost):
    token_store.write(docs, f"file://{tmp_path}/a", BYTE, 2)
    for name in ("recipes", "manifest"):
        whole = spark.read.parquet(f"file://{tmp_path}/a/{name}")
        left = whole.where(f"not coalesce({lost}, false)") if table in (name, "both") else whole
        assert (left.count() < whole.count()) == (table in (name, "both"))
        left.write.parquet(f"file://{tmp_path}/b/{name}")
    with pytest.raises(ValueError, match="do not give the manifest's"):
        token_store.read(spark, f"file://{tmp_path}/b").collect()


def test_cuts_are_found_again_after_an_insertion():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000)

    def chunks(x):
        ends = token_store.cuts(np.flatnonzero((token_store.rolling(x) & token_store._MASK) == 0), len(x))
        assert all(n <= token_store.MOST for n in np.diff([0, *ends]))
        return {x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    a, b = chunks(ids), chunks(np.insert(ids, 30_000, [1, 2, 3]))
    assert len(a & b) > 0.9 * len(a)


def test_cuts_by_blocks_are_those_of_the_whole_stream():
    ids = np.random.default_rng(2).integers(0, 300, 20_000).astype("<u4")
    for n in (0, 1, 16, 17, 20_000):
        places = np.flatnonzero((token_store.rolling(ids[:n]) & token_store._MASK) == 0)
        for block in (7, 16, 4096, token_store.BLOCK_IDS):
            assert token_store.asked(ids[:n], block).tolist() == places.tolist()


def test_packing(docs, empty):
    for group in (1 << 20, 2):
        out = packing.pack(docs, WORD, 1, group_pieces=group).collect()
        by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
        for r in out:
            by_doc[r["doc_id"], r["doc_tokens"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
        expected = collections.Counter()
        for (i, _), ids in zip(DOCS, encoded(WORD, 1), strict=True):
            for at in range(0, len(ids), 4 * 2048):
                expected[i, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192]), len(ids) // 4] += 1
        assert collections.Counter(tuple(r)[:5] for r in out) == expected
        for own in by_sequence.values():
            own.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in own] == np.append(0, np.cumsum([r["length"] for r in own])[:-1]).tolist() and sum(r["length"] for r in own) <= 2048
    assert packing.pack(empty, WORD, 1).count() == 0


def test_packing_keeps_large_ids_beside_null_ones(spark):
    """And deals rows of one doc_id, or of none, to groups like any others; ids are those of whole texts."""
    many = [(2**53 + 1, "İstanbul. İ. İ."), (None, "a b"), *[(None, "c")] * 40, *[(5, "d")] * 40]
    table = spark.createDataFrame(many, "doc_id long, text string").repartition(2)
    out = packing.pack(table, WORD, 1, group_pieces=8).collect()
    assert sorted(((r["doc_id"],) for r in out), key=key) == sorted(((i,) for i, _ in many), key=key)
    assert {r["doc_tokens"] for r in out if r["doc_id"] == 2**53 + 1} == {len(Tokenizer.from_file(WORD).encode("İstanbul. İ. İ.", add_special_tokens=False).ids) + 1}
    groups = collections.Counter((r["doc_id"], r["sequence_id"] >> 32) for r in out)
    assert max(n for (i, _), n in groups.items() if i in (None, 5)) < 25
    assert sorted(map(tuple, packing.pack(table, WORD, 1, group_pieces=8).collect()), key=key) == sorted(map(tuple, out), key=key)


def test_first_fit_decreasing_against_a_scan():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 50, 300):
        lengths = [rng.randint(1, 100) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free, expected = [], {}
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            free += [100] * (b == len(free))
            expected[i] = (b, 100 - free[b])
            free[b] -= lengths[i]
        assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [expected[i] for i in range(n)]


# ----------------------------------------------------------------------- 10


def test_licenses(docs, empty):
    out = licenses.scan(docs).collect()
    expected = []
    for doc_id, t in DOCS:
        w, places, labels = words(t, ALNUM), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        expected.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted(expected, key=key)
    (r,) = [r for r in out if r["doc_id"] == 9]
    assert r["labels"] == "cc-by,cc-by-nc-4.0,gpl,gpl-3.0" and r["score"] == 1.0
    assert all(0 <= r["score"] <= 1 for r in out) and licenses.scan(empty).count() == 0


def test_template_automata():
    a = licenses.compile_template("t", "one two <<optional>> three four <<end>> five <<any 2>> six")
    run = lambda text: a.run(text.encode().split())
    assert run("one two five six")[0] and run("one two three four five x y six more")[0] and run("one two five x six")[0]
    assert not run("one two three five six")[0] and not run("one two five x y z six")[0]
    assert run("one two three")[1] == 0.5 and run("one x")[1] == 0.25
    with pytest.raises(ValueError, match="two mandatory words"):
        licenses.compile_template("t", "one <<optional>> two <<end>> three")


def pattern_of(template: str) -> re.Pattern:
    out = []
    for kind, count, token in (m.groups() for m in licenses._TOKEN.finditer(template)):
        out.append({"optional": "(?:", "end": ")?", "any": f"(?:[^ ]+ ){{0,{count or 1}}}"}.get(kind) or re.escape(token) + " ")
    return re.compile("(?<![^ ])" + "".join(out))


def test_labels_against_regular_expressions(spark):
    """Whole licences, with each region there or not, and with one word of the wording changed, dropped or doubled."""
    rng, texts, patterns = random.Random(9), [], {k: pattern_of(t) for k, t in licenses.TEMPLATES.items()}
    for template in licenses.TEMPLATES.values():
        for kind in ("whole", "whole", "changed", "dropped", "doubled"):
            w, keep = [], True
            for k, count, token in (m.groups() for m in licenses._TOKEN.finditer(template)):
                if k == "optional":
                    keep = rng.random() < 0.5
                elif k == "end":
                    keep = True
                elif k == "any":
                    w += [rng.choice(VOCAB) for _ in range(rng.randint(0, int(count or 1)))]
                elif keep:
                    w.append(token)
            i = rng.randrange(len(w))
            w[i : i + 1] = {"whole": [w[i]], "changed": ["other"], "dropped": [], "doubled": [w[i], w[i]]}[kind]
            texts.append(", ".join([*[rng.choice(VOCAB) for _ in range(5)], *(x.upper() if rng.random() < 0.3 else x for x in w), rng.choice(VOCAB)]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = collections.Counter()
    for r in licenses.scan(table).collect():
        plain = " ".join(words(texts[r["doc_id"]], ALNUM)) + " "
        own = {k for k, p in patterns.items() if p.search(plain)}
        base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {plain}"}
        assert r["labels"] == ",".join(sorted(own | base))
        assert (r["score"] == 1.0) == bool(own) and (own or not base or r["score"] >= 0.5)
        some.update(own)
    assert set(some) == set(licenses.TEMPLATES)


# ----------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force over all that it was given."""
    import corpus_pipeline

    table, labels = labelled(spark, 300)
    some = {r["doc_id"]: r["text"] for r in table.collect()}
    more = [(1000, some[3]), (1001, PASSAGE + " " + PASSAGE), (1002, None), (1003, ""), (1004, prose(40) + " " + PASSAGE), (5, some[6] + " once more"), (None, some[8]), (None, some[3]), (1005, LONG)]
    table = table.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], table.schema)).repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    models = {"quality classifier": (quality, "quality"), "toxicity": (toxicity, "toxic")}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(rows(docs), key=key)
        texts = [r[1] for r in before]
        if name in models:
            module, _ = models[name]
            model = module.fit(docs, labels)
            scores = model.scores(pa.array(texts, pa.string())) if module is quality else model.scores(pa.array(texts, pa.string()), model.table())
            kept = [r for r, x in zip(before, scores, strict=True) if (x >= 0.3 if module is quality else x < 0.5)]
            assert 0.4 * len(before) < len(kept) < len(before)
        elif name.startswith("simhash"):
            groups = collections.defaultdict(list)
            for r, c in zip(before, brute_components([fingerprint(t) for t in texts]), strict=True):
                groups[c].append(r)
            kept = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
            assert len(kept) < len(before)
        elif name.startswith("benchmark"):
            hit = [r[5] for r in brute_contamination([(k, t) for k, t in enumerate(texts)], [(1, PASSAGE)])]
            kept = [r for r, x in zip(before, hit, strict=True) if not x]
            assert len(kept) < len(before)
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == table.columns
            # of rows that are equal but for their place any may stay
            assert sorted(rows(docs), key=key) == sorted(kept, key=key)
        else:
            tokenizer = Tokenizer.from_file(WORD)
            lengths = collections.Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in before)
            assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in docs.where("start = 0").collect()) == lengths
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    nothing = table.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
