"""The training-data operators on one table of edge cases, against brute force, and with held-out accuracy."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import components, divergence, encoding, exact_dedup, html_text, lm, minhash, mixing, negatives, packing, pii, quality, queries, sharding, shingles, token_files, toxicity

from ..compare import DATA, same, tables

LONG = " ".join(f"word{k % 977} filler{k % 13}" for k in range(20_000))
BASE = " ".join(f"alpha{k}" for k in range(120))
TEXTS = [
    None, "", " \t\n", "one", "a b", "a  b", "A B", BASE, BASE.replace("alpha7 ", "beta "), BASE.upper(), BASE + " tail", LONG, LONG + " x", "é ü ß ñ\r\n\x0bx", "same line here\nsame line here\nsame line here",
    "mail a@b.c_d@e.f and +1 (017) 555-7713", "card 4539 1488 0343 6467 ip 1.2.3.4.5.6.7.8 300.1.1.1", "you are an idiot", "i am a deaf person", "x" * 70_000,
]
SOURCES = ["hot"] * 14 + [None, "", "b", "c", "d", "hot"]


@pytest.fixture(scope="module", autouse=True)
def quick(spark):
    """Plans here run over a few rows, so that compiling them would take most of the time."""
    some = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, s, len(t or "")) for k, (t, s) in enumerate(zip(TEXTS, SOURCES, strict=True))]
    rows += [rows[7], rows[4]]  # rows that are there twice
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    # columns whose names clash with those of the operators
    return df.withColumns({c: F.lit("clash") for c in ("h", "row", "kept", "n", "size", "score", "key", "digest", "rep", "component", "host", "name", "src", "words", "units", "label", "lang")}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# exact dedup


def classes(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.keep_id].add(r.doc_id)
    return dict(out)


def brute_classes():
    groups = defaultdict(list)
    for k, t in enumerate(TEXTS):
        groups["".join(words(t))].append(k)
    return {min(g, key=lambda k: (-len(TEXTS[k] or ""), k)): set(g) for g in groups.values()}


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs)
    assert got.count() == 22 and classes(got) == brute_classes()
    kept = [r.doc_id for r in got.filter("kept").collect()]
    assert len(kept) == len(set(kept)) == len(brute_classes())
    assert exact_dedup.exact_dedup(empty).count() == 0
    some = exact_dedup.drop_exact_duplicates(docs)
    assert some.columns == docs.columns and sorted(r.doc_id for r in some.collect()) == sorted(kept)


def test_exact_dedup_with_colliding_hashes(docs):
    weak = lambda c: F.lit(b"\x01")
    assert classes(exact_dedup.exact_dedup(docs.dropDuplicates(["doc_id"]), hash_of=weak)) == brute_classes()


# toxicity


def test_toxicity_held_out(spark):
    folder = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op2_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").select("predicted", "toxic", "score").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k == 17)) for k in range(20)] + [(5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == 22 and got.filter("score is null").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.filter("doc_id < 0")).filter("score > 0.5").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_swapped_identity_changes_no_score():
    rows = [({1: 1.0, toxicity.zlib.crc32(b"deaf") % toxicity.DIM: 1.0}, 1), ({2: 1.0}, 0)] * 20
    import numpy as np

    index = np.array([f for v, _ in rows for f in v])
    value = np.array([x for v, _ in rows for x in v.values()])
    sizes = np.array([len(v) for v, _ in rows])
    f = toxicity.Features()
    pairs = [(f.vector("i am a deaf person"), f.vector("i am a blind person"))] * 50
    y = np.array([y for _, y in rows], float)
    model = toxicity.fit((index, value, sizes), y, np.ones(len(y)), pairs)
    plain = toxicity.fit((index, value, sizes), y, np.ones(len(y)), [])
    gap = lambda m: abs(m.score("i am a deaf person") - m.score("i am a blind person"))
    assert gap(model) < 0.5 * gap(plain)


# packing and token files


def test_word_memory_gives_the_library_s_ids():
    odd = [t for t in TEXTS if t] + ["a   b", "a\n b", "\n\na \n", "don't I'll", "é́a b\xa0c", "<|endoftext|> x", "I\x1cb", "ÀÉ İ ß ŉ", "ﬁ ½ 12345 a1b2", "名前 です。", "😀 ok", "a\r\nb\ttab", " lead", "trail "]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        code = encoding.Encoder(queries.tokenizer(name))
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in code.tokenizer.encode_batch(odd, add_special_tokens=False)]
        assert code.encode(odd) == want


def test_best_fit_decreasing():
    lengths = [5, 3, 8, 2, 7, 1, 4, 6, 8, 2]
    places = packing.best_fit_decreasing(lengths, 8)
    filled = defaultdict(list)
    for (w, o), n in zip(places, lengths, strict=True):
        filled[w].append((o, n))
    for some in filled.values():
        at = 0
        for o, n in sorted(some):
            assert o == at
            at += n
        assert at <= 8
    assert len(filled) == math.ceil(sum(lengths) / 8)


def test_packing(docs, empty):
    path = queries.tokenizer("byte_bpe_50k.json")
    code = encoding.Encoder(path)
    ids = {k: list(struct.unpack(f"<{len(b) // 4}I", b)) + [1] for k, b in enumerate(code.encode(TEXTS))}
    rows = packing.pack(docs, path, capacity=64, group_tokens=5_000).collect()
    filled, seen = defaultdict(list), Counter()
    for r in rows:
        piece = list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))
        assert piece == ids[r.doc_id][r.start : r.start + len(piece)] and r.doc_tokens == len(ids[r.doc_id])
        filled[r.sequence_id].append((r.offset, len(piece)))
        seen[r.doc_id] += len(piece)
    assert all(seen[k] == len(v) * (2 if k in (4, 7) else 1) for k, v in ids.items())
    for some in filled.values():
        at = 0
        for o, n in sorted(some):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty, path).count() == 0


def test_small_memory_gives_the_same_ids():
    path = queries.tokenizer("byte_bpe_50k.json")
    assert encoding.Encoder(path, cache_bytes=2_000).encode(TEXTS) == encoding.Encoder(path).encode(TEXTS)


def test_token_files_round_trip(spark, docs, empty):
    path = queries.tokenizer("word_bpe_49k.json")
    code = encoding.Encoder(path)
    # three ranges of several parts each
    manifest = token_files.write_token_files(docs, token_files.folder(spark), path, length=16, part_docs=4, ranges=3)
    assert [r.number for r in manifest.orderBy("number").collect()] == list(range(manifest.count())) and manifest.select("range").distinct().count() == 3 < manifest.count()
    read = token_files.read_token_files(manifest)
    assert read.rdd.getNumPartitions() == manifest.count() and token_files.read_token_files(manifest, readers=2).count() == 22
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    at = 0
    for r, k in zip(got, sorted([*range(20), 4, 7]), strict=True):
        want = code.encode([TEXTS[k]])[0] + struct.pack("<I", 1)
        assert (r.doc_id, r.start, r.ids) == (k, at, want)
        at += len(want) // 4
    part = token_files.TokenFile(manifest.orderBy("number").first()["path"])
    ids, mask = part.sequence(0)
    assert len(ids) == 16 and not ids.flags.owndata and mask[0].as_py()
    assert token_files.read_token_files(token_files.write_token_files(empty, token_files.folder(spark), path)).count() == 0


def test_token_queries(spark):
    """The digest columns of the two queries, from the library's own ids."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for name, run in (("byte_bpe_50k.json", queries.op3_packing), ("word_bpe_49k.json", queries.op6_token_files)):
        code = encoding.Encoder(queries.tokenizer(name)).tokenizer
        ids = {k: [*code.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
        crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
        rows = run(spark, DATA).collect()
        if "sequence_id" in rows[0]:
            for r in rows:
                assert (r.length, r.ids_crc32, r.doc_tokens) == (len(x := ids[r.doc_id][r.start : r.start + r.length]), crc(x), len(ids[r.doc_id]))
                assert r.padded_length == (r.sequence_tokens if r.sequence_tokens & (r.sequence_tokens - 1) == 0 else 2_048) and r.offset + r.length <= r.sequence_tokens <= 2_048
        else:
            at = 0
            for r in sorted(rows, key=lambda r: r.doc_id):
                assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
                at += r.n_tokens


# pages


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1><a href=/>Home</a></header><nav><a>Menu</a></nav>
<div class="cookie-notice">We use cookies to give you the best experience on our site, accept them all now.</div><script>var t="</p>";</script>
<article><h2>Real  title</h2><p>First paragraph &amp; more &eacute; <b>bold</b>.</p><p>Short.</p><ul><li>item one</li></ul>
<aside>Side text that is long enough to look like an article but is none.</aside><form><label>Name</label></form>
<div class="comments"><p>I think this is a wonderful article and say so at some length here.</p></div></article><footer>Copyright</footer>"""


def test_html():
    assert html_text.main_text(PAGE) == "Real title\n\nFirst paragraph & more é bold.\n\nShort.\n\nitem one"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<!-- open") == ""
    assert html_text.main_text("<article>one<p>two &lt;x&gt; <script>no") == "one\n\ntwo <x>"
    assert html_text.main_text("<" * 50_000 + "<p a='" * 1_000) is not None


# Pages with the text that a reader would call the article.
PAGES = {
    """<body><div id="top-menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><main><h1>Tide tables return</h1>
<p>The harbour office has printed tide tables again after ten years without them.</p><p>They cost two coins, and <a href="/b">boat owners</a> get them free.</p>
<blockquote>We kept asking for them.</blockquote></main><div class="related-links"><h3>More</h3><a href="/1">Old bridge closed for the winter months</a></div><footer><p>All rights reserved by the harbour paper.</p></footer>""": "Tide tables return\n\nThe harbour office has printed tide tables again after ten years without them.\n\nThey cost two coins, and boat owners get them free.\n\nWe kept asking for them.",
    """<html><body><table><tr><td><a href=1>Index</a></td><td><a href=2>Search</a></td></tr></table><p>Long before the mill was built, the valley held nothing but reeds and a few goats that belonged to nobody in particular.</p>
<p>The miller came in spring with two carts, a dog and a plan that he would not tell anyone for the next eleven years of his life.</p><p><a href=3>Next page</a></p></body></html>""": "Long before the mill was built, the valley held nothing but reeds and a few goats that belonged to nobody in particular.\n\nThe miller came in spring with two carts, a dog and a plan that he would not tell anyone for the next eleven years of his life.",
    """<article><header><h2>Bread</h2></header><p>Mix flour, water and salt.</p><pre>1 kg flour</pre><figure><figcaption>A loaf</figcaption></figure><div class="newsletter-signup"><p>Get a recipe by post every week, free of charge, for as long as you like.</p></div>
<p>Bake it.</p><section id="comments"><p>My loaf was flat, what have I done wrong with the second rise?</p></section></article><aside><p>Ten ovens compared by people who own all of them.</p></aside>""": "Bread\n\nMix flour, water and salt.\n\n1 kg flour\n\nA loaf\n\nBake it.",
    """<nav><p>Menu</p></nav><div role="main"><div hidden>Secret text that nobody sees on the page at all.</div></div><form><p>Send us your address and we will answer within a week.</p></form>""": "",
}


def test_html_accuracy():
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text


def test_hostile_pages_take_linear_time():
    import time

    for part in ("<script ", "<a \">\" ", "<div></p>", "<div><head><body>", "<span class=ad></b>", "<!-- <p>", "<p a='", "<li><a>"):
        began = time.process_time()
        html_text.main_text(part * 60_000)
        assert time.process_time() - began < 5, part


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert [(r.page_id, r.n_chars == len(r.text)) for r in got] == [(1, True), (2, True), (1, True)]
    assert html_text.extract(pages.filter("page_id > 5")).count() == 0


# quality


def test_quality(spark, docs, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for k, t in enumerate(TEXTS):
        w = words(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words, got[k].n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines))), k
    assert quality.quality(empty).count() == 0
    same(queries.op5_quality(spark, DATA), quality.SQL)


def test_bad_host_is_rejected(spark):
    good = " ".join(f"w{k}" for k in range(50))
    rows = [(k, good if k % 10 == 0 else "a b", "bad") for k in range(300)] + [(1_000 + k, good, "fine") for k in range(300)]
    kept = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").select("doc_id").collect()
    assert {r.doc_id for r in kept} == set(range(1_000, 1_300))


def test_one_document_rejects_no_host(spark):
    good = " ".join(f"w{k}" for k in range(51))
    rows = [(k, good + " ######" * (k % 20 == 0), f"host{k}") for k in range(200)]
    assert quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("not kept").count() == 0


# near-duplicates


def brute_components(texts, threshold=85):
    sets = {}
    for k, t in enumerate(texts):
        w = words(ascii_lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    of = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((of[a], of[b]))
                of = {k: x if v == y else v for k, v in of.items()}
    return {k: (len(sets[k]), of[k]) for k in sets}


def test_near_duplicates(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(TEXTS) and len(got) == 22
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_edited_copies(spark):
    import random

    rng = random.Random(3)
    base = [f"t{k}" for k in range(150)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}


def test_shingles_in_chunks(monkeypatch):
    whole = shingles.shingles(LONG)
    monkeypatch.setattr(shingles, "CHUNK", 1_000)
    assert (shingles.shingles(LONG) == whole).all() and len(shingles.shingles("a b")) == 1 and len(shingles.shingles(" ")) == 0


# personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, found):
    digits = re.sub("[^0-9]", "", found)
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    luhn = sum(v - 9 if v > 9 else v for v in each) % 10 == 0
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in found.split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15


def test_pii(spark, docs, empty):
    more = ["a@b.c_d@e.f g@h.i.j..k@l.m @x.y é😀 z@q.w", "0001.002.3.255 12.34 1.2.3.4", "12--4539148803436467 4539148803436467-1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+" * 40 + "1234567890123"]
    extra = spark.createDataFrame(list(enumerate(more, 100)), "doc_id long, text string")
    texts = dict(enumerate(TEXTS)) | dict(enumerate(more, 100))
    for r in pii.find_pii(docs.select("doc_id", "text").union(extra)).collect():
        want = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, texts[r.doc_id] or "") if accepted(k, m[0]))
        assert [tuple(s) for s in r.base] == want
    assert pii.report(empty).count() == 0


def test_pii_of_texts_that_end_a_recursive_matcher(spark):
    n = 100_000
    one = ["a@b" + ".c" * n, "1" + ".1" * n, "+" + "1." * n + "1", "(1)-" * n + "1", "1 " * n + "1", "a" + ".-" * n + "1", "x 1" + "." * n + "a"]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(one)), "doc_id long, text string")).collect()}
    assert got[0].n_email == 1 and got[0].spans == f"email:0:{len(one[0])}"
    assert [got[k].n_email for k in range(1, len(one))] == [0] * (len(one) - 1)
    assert got[1].n_ip == (n + 1) // 4 and got[2].n_phone == 0


def test_contexts_find_what_patterns_miss(spark):
    texts = [f"please note my email is user{k}@mail.com thanks" for k in range(9)] + ["so my email is user(at)5566 ok", "it is number 5566 ok"]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[9] == "email:15:27" and got[10] == ""


def test_identifiers_with_spaces_are_whole(spark):
    """Phones and cards are instances as a whole, so that they teach patterns, and unseen ones are found uncut."""
    cards = ("4539 1488 0343 6467", "4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "5555 5555 5555 4444")
    texts = [f"you can phone me +1 (0{k}) 555-77{k} or not" for k in range(11, 31)] + [f"you can charge card {c} now" for c in cards]
    texts += [f"see my phone: +1 (0{k}) 555-77{k}" for k in range(41, 51)]
    new = ["do phone me (017) 555-7713 soon", "do phone me 017 555 7713. 2019 was", "do charge card 4539 1488 0343 now", "no word of 017 555 7713", "at my phone:017 555 7713, ok", "do phone me 5566 1.2.3.4"]
    got = [r.spans for r in sorted(pii.report(spark.createDataFrame(list(enumerate(texts + new)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    assert got[len(texts) :] == ["phone:12:26", "phone:12:24", "card:15:29", "", "phone:12:24", "phone:12:16,ip:17:24"]


def brute_spans(texts):
    """Spans by the module's patterns, with the graph scored in plain loops."""
    import regex

    context = regex.compile(pii.CONTEXT.replace(r"\z", r"\Z"))
    found = []  # doc, kind, start, end, context, core
    for d, text in texts.items():
        base = []
        for no, kind in enumerate([*pii.KINDS, "token"]):
            at = 0
            for k, m in enumerate(regex.finditer(pii.PATTERNS.get(kind, pii.TOKEN), text)):
                before, at = ("0" if k else "") + text[at : m.start()], m.end()
                c = context.search(before)
                c = re.sub(r"[\x20\x09-\x0D]+", " ", c[1].lower()) if c else ""
                core = m[0] if kind != "token" else regex.search(r"^[^A-Za-z0-9@+]*(.*?)[^A-Za-z0-9]*$", m[0])[1]
                if kind == "token" and any(b[1] < m.end() and m.start() < b[2] for b in base) or kind != "token" and not accepted(kind, m[0]):
                    continue
                base.append((d, m.start(), m.end()))
                found.append((d, no, m.start(), m.end(), c, core.lower()))
    edges = {}
    for _, no, _, _, c, core in found:
        if c and core:
            edges[c, core] = max(edges.get((c, core), -1), no if no < 4 else -1)
    size = Counter(c for c, _ in edges)
    state = {e: (seed, 1.0) if seed >= 0 else (-1, 0.0) for e, seed in edges.items() if size[e[0]] >= pii.SUPPORT}
    for _ in range(pii.ROUNDS):
        mass, known = Counter(), Counter()
        for (c, _), (kind, score) in state.items():
            if score > 0:
                mass[c, kind] += score
                known[c, kind] += 1
        best = {}
        for c, kind in mass:
            if c not in best or (mass[c, kind], -kind) > (mass[c, best[c]], -best[c]):
                best[c] = kind
        best = {c: (mass[c, k] / size[c], k) for c, k in best.items() if known[c, k] >= pii.SUPPORT and mass[c, k] / size[c] >= pii.CONFIDENCE}
        reach = {}
        for c, core in state:
            if c in best and edges[c, core] < 0:
                reach[core] = max(reach.get(core, (0, 0)), best[c])
        state = {e: (edges[e], 1.0) if edges[e] >= 0 else (reach[e[1]][1], reach[e[1]][0]) if e[1] in reach else (-1, 0.0) for e in state}
    out = defaultdict(list)
    for d, no, start, end, c, core in found:
        if no < 4:
            out[d].append((start, no, end))
        elif c in best and (len(re.sub("[^0-9]", "", core)) >= pii.DIGITS or "@" in core):
            out[d].append((start, best[c][1], end))
    return {d: ",".join(f"{pii.KINDS[no]}:{a}:{b}" for a, no, b in sorted(out[d])) for d in texts}


def test_discovered_spans_by_brute_force(spark):
    import random

    rng = random.Random(11)
    frames = ["reach me under {}", "my card no {} ok", "write to\t\tme: {}", "the host at {} is down", "see page {} of it", "LONG" * 40 + " words " + " " * 80 + "{}"]
    kinds = [lambda: f"+1 (0{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)}", lambda: f"u{rng.randint(0, 30)}@mail.org", lambda: f"10.0.{rng.randint(0, 9)}.{rng.randint(0, 255)}", lambda: f"{rng.randint(100, 999)} {rng.randint(1000, 9999)}", lambda: f"x{rng.randint(0, 50)}(at)mail77"]
    favourite = [0, 3, 1, 2, 3, 0]
    texts = {}
    for k in range(150):
        some = []
        for _ in range(rng.randint(1, 5)):
            f = rng.randrange(len(frames))
            some.append(frames[f].format(kinds[favourite[f] if rng.random() < 0.9 else rng.randrange(5)]()))
        texts[k] = ". ".join(some)
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_spans(texts)
    assert got == want
    base = {k: sum(accepted(kind, m[0]) for kind, p in KINDS.items() for m in re.finditer(p, t)) for k, t in texts.items()}
    assert sum(len([x for x in w.split(",") if x]) - base[k] for k, w in want.items()) > 5


# language model


def test_lm(docs, empty):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), b""] for k, t in enumerate(TEXTS)}
    counts = Counter()
    for k, t in tokens.items():
        if zlib.crc32(str(k).encode()) % 10:
            counts.update(t * (2 if k in (4, 7) else 1))
    n, v = sum(counts.values()), len(counts)
    for k, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert math.isclose(got[k].base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert got[k].score < 0
    assert lm.score(empty).count() == 0


def test_lm_is_normalised_and_learns():
    import numpy as np

    vocab = lm.Vocabulary([f"w{k}".encode() for k in range(300)], np.arange(400, 100, -1), 75_000, 400).with_rest({k: (30_000, 150) for k in range(3)})
    assert vocab.classes == 3 and len(set(vocab.unit[:300])) == 300
    members = np.flatnonzero(vocab.used).astype(np.int32)
    assert len(members) == 303
    cycle = vocab.unit[np.arange(20)]
    units = np.tile(cycle, 1_000).astype(np.int32)
    model, rng = lm.LogBilinear(vocab.mass, vocab.used), np.random.default_rng(0)
    one, two = model.contexts(units, np.array([len(units)]))
    each = lambda: sum(10 ** model.log10(one[:9], two[:9], np.full(9, u, np.int32)) for u in members)
    assert np.allclose(each(), 1, atol=1e-4)
    before = model.log10(one[8:48], two[8:48], units[8:48]).mean()
    for _ in range(30):
        for at in range(0, len(units), 1_000):
            part = slice(at, at + 1_000)
            model.learn(one[part], two[part], units[part], rng)
    assert np.allclose(each(), 1, atol=1e-4)
    # drawn noise brings the followers of a cycle near, though not to certainty
    assert before < -2.3 and model.log10(one[8:48], two[8:48], units[8:48]).mean() > -0.6


def lm_brute(texts, flat, vocab):
    """The score of each text by one softmax over the classes and one over the units of a class, token by token."""
    import numpy as np

    model = lm.LogBilinear(vocab.mass, vocab.used, flat)
    place = {w: k for k, w in enumerate(vocab.words)}
    out = []
    for text in texts:
        unit = [int(vocab.unit[place[w]]) if w in place else vocab.rest_unit(w) for w in lm.words(text)]
        total = 0.0
        for k, u in enumerate(unit):
            one, two = unit[k - 1] if k else vocab.units, unit[k - 2] if k > 1 else vocab.units
            h = np.append(model.c[0] * model.r[one] + model.c[1] * model.r[two], 1).astype(float)
            kind = u // lm.PLACES
            own = [x for x in range(kind * lm.PLACES, (kind + 1) * lm.PLACES) if vocab.used[x]]
            of_class, of_unit = model.k.astype(float) @ h, model.q[own].astype(float) @ h
            total += (of_class[kind] - np.logaddexp.reduce(of_class) + of_unit[own.index(u)] - np.logaddexp.reduce(of_unit)) / math.log(10) - vocab.level[u]
        out.append(total)
    return out


def test_lm_score_by_brute_force(spark, monkeypatch):
    import numpy as np

    from docloom.llm.common import durable

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("length(text) < 900").limit(60)
    docs = durable(docs, "test")
    counts = lm.count_words(docs.filter(~lm.held_out(F.col("doc_id"))))
    vocab = lm.vocabulary(counts)
    encoded = durable(lm.encode(docs, spark.sparkContext.broadcast(vocab)).withColumn("held_out", lm.held_out(F.col("doc_id"))), "test")
    flat = lm.train(encoded, vocab)
    # the same model however the rows are split
    assert np.allclose(flat, lm.train(encoded.repartition(3), vocab), atol=1e-5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    number = {r.word: r.c for r in counts.collect()}
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    some = sorted(texts)[:8]
    for k, lbl in zip(some, lm_brute([texts[k] for k in some], flat, vocab), strict=True):
        want = lbl + sum(math.log10(number.get(w, 0) + 0.1) for w in lm.words(texts[k]))
        assert math.isclose(got[k], want, rel_tol=1e-4), k


def test_lm_learns_more_than_counts(spark):
    folder = DATA.replace("0.001", "0.01")
    r = queries.op9_lm(spark, folder).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.1


# mixing


def test_targets(spark):
    rows = [("a", 10), ("b", 1_000), ("c", 5), (None, 300)]
    got = {r["name"]: r.target for r in mixing.targets(spark.createDataFrame(rows, "name string, source_size long")).collect()}
    # a, b, c, null weigh 1, 2, 3, 1; a and c stop at three times their size
    assert math.isclose(sum(got.values()), 1_315) and got["a"] == 30 and got["c"] == 15
    assert math.isclose(got["b"], (1_315 - 45) * 2 / 3) and math.isclose(got[None], (1_315 - 45) / 3)


def test_mixing(docs, empty):
    rows = mixing.taken_words(docs).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(words(TEXTS[r.doc_id])) and r.taken <= 3 * r.size
        by[r.source_size, r.target].append(r.taken)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.taken_words(docs).collect()))
    assert mixing.taken_words(empty).count() == 0


def test_taken_by_brute_force(spark):
    """Layout, draws, permutations and the join again in plain loops."""
    import xxhash

    def spark_hash(*values):
        seed = 42
        for v, size in values:
            seed = xxhash.xxh64(v.to_bytes(size, "little", signed=True), seed).intdigest()
        return seed - (1 << 64) if seed >> 63 else seed

    def place(x, n, *key):
        for r in range(mixing.SHUFFLES):
            other = (spark_hash((r, 4), *key) % n - x) % n
            x = other if spark_hash((r, 4), (max(x, other), 8), *key) % 2 else x
        return x

    rows = [(k, " ".join(f"w{k}_{j}" for j in range(k * 7 % 23)), "abcd"[k % 3] if k % 7 else None) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, _, used = mixing.mix(docs, block=4, shard=16)
    got_uses = {(r["src"], r["index"]): r.uses for r in used.collect()}
    taken, by_source = {}, defaultdict(list)
    for r in placed.collect():
        by_source[r.src].append(r)
    slots = {}
    for src, some in by_source.items():
        at = 0
        for r in sorted((r for r in some if r.size), key=lambda r: r["at"]):
            assert r["at"] == at
            at += r.size
        assert at == some[0].source_size
        slots[src] = some[0].target * -(-at // 4) / at
    need = {s: math.floor(x) for s, x in slots.items()}
    for s in sorted(need, key=lambda s: (need[s] - slots[s], s))[: round(sum(slots.values())) - sum(need.values())]:
        need[s] += 1
    for src, some in by_source.items():
        n = -(-some[0].source_size // 4)
        uses = Counter(place(k % n, n, (src, 4), (k // n, 8), (7, 4)) for k in range(need[src]))
        assert uses == {i: u for (s, i), u in got_uses.items() if s == src}
        for r in some:
            taken[r.doc_id] = sum(uses[p // 4] for p in range(r["at"], r["at"] + r.size))
    assert {r.doc_id: r.taken for r in mixing.taken_words(docs, block=4, shard=16).collect()} == taken


def test_shards_are_multinomial_draws(spark):
    share = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, 60.0)], "src int, slots double")
    by = defaultdict(dict)
    for r in mixing.shard_counts(share, 200_000, 1_000, 7).collect():
        by[r.shard][r.src] = r.n
    assert len(by) == 200 and all(sum(x.values()) == 1_000 for x in by.values())
    for src, p in ((1, 0.1), (2, 0.3), (3, 0.6)):
        some = [x.get(src, 0) for x in by.values()]
        mean = sum(some) / 200
        assert abs(mean - 1_000 * p) < 5 and 0.7 < sum((x - mean) ** 2 for x in some) / 200 / (1_000 * p * (1 - p)) < 1.4


def test_permutation_of_very_many_blocks(spark):
    n = 3 * 10**12
    x = spark.range(200).select((F.col("id") * 14_999_999_999).alias("x")).withColumn("y", mixing.permuted(F.col("x"), F.lit(n), F.lit(3)))
    rows = x.withColumn("z", mixing.permuted(F.col("y"), F.lit(n), F.lit(3), inverse=True)).collect()
    assert all(r.x == r.z and 0 <= r.y < n for r in rows) and len({r.y for r in rows}) == 200
    assert sorted(r.y for r in spark.range(777).select(mixing.permuted(F.col("id"), F.lit(777).cast("long"), F.lit(1)).alias("y")).collect()) == list(range(777))


def test_mix_is_near_its_targets(spark):
    folder = DATA.replace("0.001", "0.01")
    for r in queries.op10_mixing(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect():
        assert abs(r.t / r.goal - 1) < 0.05


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_cut_documents_keep_their_white_space(spark):
    rows = [(k, "  " + "\n".join(f"a{k} b{j}\tc" for j in range(40)) + "\n", "one") for k in range(3)] + [(9, "x " * 900, "two")]
    texts = {k: t for k, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__parts", F.lit(1)).withColumn("src", F.lit("clash"))
    out = mixing.mixed_documents(docs, block=8, shard=4)
    assert out.columns == docs.columns and mixing.mixed_documents(docs.filter("doc_id < 0")).count() == 0
    for r in out.collect():
        for line in r.text.split("\n"):
            assert line in texts[r.doc_id]


# queries


def test_null_ids(spark):
    """A null doc_id is a document of its own, as each operator's docstring says."""
    docs = spark.createDataFrame([(None, BASE, "a"), (1, BASE, "a"), (None, "one two", None), (2, "you are an idiot " * 5, "b")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    of = lambda df: [r.asDict() for r in df.filter("doc_id is null").collect()]
    assert sorted((r["keep_id"] is None, r["kept"]) for r in of(exact_dedup.exact_dedup(docs))) == [(False, False), (True, True)]
    assert [r["held_out"] for r in of(toxicity.toxicity(docs, labels))] == [False, False]
    assert len(of(packing.pack(docs, queries.tokenizer("byte_bpe_50k.json")))) >= 2
    assert len(of(quality.quality(docs))) == len(of(pii.report(docs))) == len(of(mixing.taken_words(docs))) == 2
    assert all(r["kept"] and r["component_id"] is None for r in of(minhash.near_duplicates(docs)))
    assert [r["held_out"] for r in of(lm.score(docs))] == [False, False]
    manifest = token_files.write_token_files(docs, token_files.folder(spark), queries.tokenizer("word_bpe_49k.json"))
    assert [r["start"] for r in of(token_files.read_token_files(manifest))][0] == 0


def test_pipeline_stages_on_edge_cases(spark, docs, empty, tmp_path):
    """Every stage on nulls, ties, repeated rows and clashing columns, and on an empty table; all but the last return the input's columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = str(tmp_path)
    spark.createDataFrame([(k, int(k == 17)) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    null = spark.createDataFrame([(None, "a row without an id", None, 19)], docs.select("doc_id", "text", "source", "n_chars").schema)
    for some in (docs.unionByName(null, allowMissingColumns=True), empty):
        for name, stage in pipeline.STAGES:
            before = some
            some = pipeline.common.durable(stage(spark, before, folder), "test")
            if name != "packing":
                assert some.columns == before.columns
                assert name == "mixing" or some.join(before.select("doc_id", "text"), ["doc_id", "text"], "left_anti").filter("doc_id is not null and text is not null").count() == 0
    assert some.count() == 0


def test_oracles(spark):
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, DATA), sql)
    assert tables()


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:3]:
        docs = pipeline.common.durable(stage(spark, docs, DATA), "test")
        sizes.append(docs.count())
    assert docs.columns == spark.read.parquet(f"{DATA}/documents.parquet").columns and sizes == sorted(sizes, reverse=True)
    left = [r.text for r in docs.collect()]
    assert len({"".join(words(t)) for t in left}) == len(left)
    assert all(k == v[1] for k, v in brute_components(left, 80).items())
    pending = pipeline.common.durable(spark.range(3), "test")
    before = pipeline.common.made()
    pieces = pipeline.run(spark, DATA)
    # one table of the run is left, and tables of others are not touched
    assert pieces.count() > 0 and pipeline.common.made() == before + 1 and pending.count() == 3


# sharding


def brute_shards(ids, shards, slack=0.0):
    """Documents one by one in order of turns, each to the first shard clockwise with room."""
    import hashlib

    nodes = sharding.ring(shards)
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)] if not slack else [math.ceil(len(ids) * (1 + slack) / shards)] * shards
    keyed = sorted((int(d[15:30], 16), int(d[:15], 16), k) for k in ids for d in [hashlib.md5(str(k).encode()).hexdigest()])
    out = {}
    for _, p, k in keyed:
        at = next((i for i, (x, _) in enumerate(nodes) if x >= p), 0)
        s = next(s for i in range(len(nodes)) for s in [nodes[(at + i) % len(nodes)][1]] if room[s])
        room[s] -= 1
        out[k] = s
    return out


@pytest.mark.parametrize(("shards", "slack"), [(8, 0.0), (3, 0.1), (5, 0.5)])
def test_shards_as_one_by_one(spark, shards, slack):
    rows = spark.range(997).selectExpr("id * 7 as doc_id", "concat('text ', id) as text")
    got = {r.doc_id: r for r in sharding.shard(rows, shards, slack, part_rows=10).collect()}
    assert {k: r.shard for k, r in got.items()} == brute_shards([7 * k for k in range(997)], shards, slack)
    for s in range(shards):
        own = sorted(r.slot for r in got.values() if r.shard == s)
        assert own == list(range(len(own)))


def test_sharding_like_sql(spark):
    same(queries.op13_sharding(spark, DATA), sharding.SQL)


def test_sharding_edges(spark, docs, empty, tmp_path):
    got = sharding.report(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 22 and max(sizes.values()) - min(sizes.values()) <= 1
    for r in got:
        data = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert sharding.report(empty).count() == 0
    # a third of all rows with one id, and null ids, are dealt evenly
    hot = spark.range(900).selectExpr("case when id % 3 = 0 then 5 when id % 7 > 0 then id end as doc_id", "if(id % 3 = 0, 'x', null) as text")
    got = sharding.shard(hot, part_rows=4).collect()
    assert set(Counter(r.shard for r in got).values()) == {112, 113}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(112 + (s < 4))) for s in range(8))
    written = {r.shard: r.n for r in sharding.write_shards(docs, f"file://{tmp_path}/shards").collect()}
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert {r._shard: r["count"] for r in back.groupBy("_shard").count().collect()} == written
    assert sorted((r.doc_id, r.text or "") for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())


def test_few_rows_move_to_a_new_shard(spark):
    rows = spark.range(4_000).selectExpr("id as doc_id", "'t' as text")
    eight, nine = ({r.doc_id: r.shard for r in sharding.shard(rows, n, 0.25).collect()} for n in (8, 9))
    assert sum(eight[k] != nine[k] for k in eight) < 0.3 * len(eight)


# source divergence


def brute_audit(rows, least):
    """rows: (text, lang, source) of each document."""
    out, terms = [], [[m.lower() if m.isascii() else ascii_lower(m) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for t, _, _ in rows]
    group = [(lang or "", source or "") for _, lang, source in rows]
    for lang in {g[0] for g in group}:
        own = [k for k, g in enumerate(group) if g[0] == lang]
        df = Counter(x for k in own for x in set(terms[k]))
        kept = sorted((x for x in df if df[x] >= least), key=str.encode)
        counts = {s: Counter(x for k in own if group[k][1] == s for x in terms[k] if df[x] >= least) for s in {group[k][1] for k in own}}
        every = sum(counts.values(), Counter())
        p = lambda c, x: 1 + 1_000_000_000 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            pairs = [(-sum(f(p(c, x), p(o, x)) for x in kept), t.encode(), t) for t, o in counts.items() if t != s]
            best = [(-f(p(c, x), p(every, x)), x.encode(), x) for x in kept if c[x] and p(c, x) > p(every, x)]
            out += [(lang, s, "pair", t, -v, k) for k, (v, _, t) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(best)[:10], 1)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    import random

    rng = random.Random(5)
    names = ["É", "zß", "Straße", "naïve", "x", "Y", "zz"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(None, "en", "a"), ("", None, None), ("12 34", "de", "only"), ("one", None, "b"), ("x " * 50, "en", "hot"), ("x " * 50, "en", "hot")]
    rows += [(" ".join(rng.choices(names, weights=range(1, 28), k=rng.randrange(1, 30))) + "-A_b1c", rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 6 + ["b", "c", None, ""])) for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "src", "value", "rank", "item", "doc_id", "l")})
    want = brute_audit(rows, 10)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(want) > 100 and sorted(got) == want
    assert sorted(map(tuple, divergence.audit(df, least=1_000).collect())) == brute_audit(rows, 1_000)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_in_small_steps(spark):
    """Texts in chunks, tallies of few entries: the same numbers as in one go."""
    import numpy as np

    data = "Ab cé, dé\x00ef ".encode() * 50
    before, divergence.CHUNK = divergence.CHUNK, 7
    try:
        assert Counter(x for c in divergence.chunks(data) for x in divergence._TERM.findall(c.lower())) == Counter(divergence._TERM.findall(data.lower()))
        assert len(list(divergence.chunks(data))) > 50
    finally:
        divergence.CHUNK = before
    cols = divergence.tallied(np.array([3, 3, 5, 5, 5, 9]), np.array([1, 4, 1, 2, 4, 2]), np.array([7, 8, 7, 1, 8, 1]))
    assert sorted(zip(*(c.tolist() for c in cols), strict=True)) == [(1, 2, 7, 1, 1), (1, 4, 7, 8, 2), (2, 4, 1, 8, 1)]


def test_shares_are_exact(spark):
    n, total, v = 10**15 + 7, 10**16 + 3, 10**6 + 1
    df = spark.createDataFrame([(n, total, v), (0, 0, 0)], "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v), 1]


# hard negatives


def brute_negatives(rows):
    import numpy as np

    wide = max((len(v) for _, v, _ in rows if v), default=0)
    some = [(k, [math.floor(256 * float(x)) for x in v] + [0] * (wide - len(v)), int(np.fmod(y + 1, 10)) if k % 7 == 0 else y) for k, v, y in rows if None not in (k, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, v, y in some:
        if k % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in some)
        for s, j, _ in [r for r in scored if r[2] == y and r[1] != k][:5]:
            inside = [r for r in scored if r[2] != y and -30 * s <= -100 * r[0] <= -90 * s][:10]
            out += [(k, j, n, i, -s, -t) for n, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(k, [round(rng.gauss(0.3 * (j == k % 4), 0.2), 2) for j in range(6)], k % 4) for k in range(900)]
    rows += [(3_000 + k, [0.5] * 6, k % 3) for k in range(40)]  # ties
    rows += [(None, [1.0] * 6, 1), (1_001, None, 1), (1_002, [1.0] * 6, None), (1_003, [1.0, None] * 3, 1), (1_004, [math.nan] + [1.0] * 5, 1), (1_005, [math.inf] * 6, 1)]
    rows += [(1_100, [0.9, 0.9], 2), (1_200, [], 1), (1_300, [-5.0] * 6, 0), (1_301, [3.0, -200.0, 0.0, 0.0, 0.0, 7.0], -12), (1_400, [3.0, -200.0, 0.0, 0.0, 0.0, 7.0], -2), rows[200], rows[200], rows[201]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("x", "n", "ids", "anchor", "score", "rank", "labels")})
    want = brute_negatives(rows)
    assert len(want) > 300
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == want
    for name, value in {"ROWS": 50, "ANCHORS": 3, "TILE": 2, "CELLS": 16, "STRIPES": 3}.items():
        monkeypatch.setattr(negatives, name, value)
    assert sorted(map(tuple, negatives.hard_negatives(df).collect())) == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 200")).count() == 0


def test_scores_of_any_size():
    import numpy as np

    for top in (100, 2**24, 2**29, 2**31 - 1):
        x, q = np.array([[top, -top, 3], [1, 2, -top]], np.int64), np.array([top, top - 1, 5], np.int64)
        assert negatives.exact(x, q).tolist() == [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in x]
        low, width = [-top] * 3, [(2 * top) // negatives.CELLS + 1] * 3
        cells = ((x + top) // width[0]).astype(np.uint8).T
        lower, upper = negatives.Tables(q[None], low, width).bounds(cells, np.arange(2))
        assert all(lower[k, 0] <= s <= upper[k, 0] for k, s in enumerate(negatives.exact(x, q).tolist()))
    with pytest.raises(OverflowError):
        negatives.exact(np.array([[2**61, 2**61]]), np.array([2**61, 2**61]))


@pytest.mark.parametrize("name", ["op11_divergence", "op12_hard_negatives"])
def test_like_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLES[name])


def test_log_sums_of_any_scores():
    """Sums that would run over or under in 32 bits, ordinary ones, and their cost beside moving every row first."""
    import numpy as np

    from docloom.llm.lm import LogBilinear

    rng = np.random.default_rng(3)
    for low, high in ((-5, 5), (-79, 79), (-300, -200), (90, 300), (-300, 300)):
        x = rng.uniform(low, high, (50, 128)).astype(np.float32)
        want = np.logaddexp.reduce(x.astype(float), axis=1)
        assert np.allclose(LogBilinear._log_sums(x.copy()), want, rtol=1e-5, atol=1e-5)
    assert LogBilinear._log_sums(np.zeros((0, 128), np.float32)).shape == (0,)
    # ordinary scores are not moved: what is left of them are their own exponentials
    x = np.zeros((2, 128), np.float32) + np.float32(2)
    LogBilinear._log_sums(x)
    assert np.allclose(x, np.exp(2))


def test_a_step_takes_all_classes_together():
    """A gradient step against one made token by token; as many calls for targets of all classes as for those of two."""
    import sys

    import numpy as np

    from docloom.llm import lm

    words = [b"w%d" % k for k in range(lm.CLASSES * (lm.PLACES - 1))]
    vocab = lm.Vocabulary(words, np.arange(20_000, 20_000 - len(words), -1), 10**9, 10**6).with_rest({k: (10**7, 5_000) for k in range(lm.CLASSES)})
    rng = np.random.default_rng(2)

    def step(units: int):
        m, calls = lm.LogBilinear(vocab.mass, vocab.used), []
        start = {name: getattr(m, name).astype(float) for name in m.NAMES}
        one, two, target = rng.integers(0, 40, 400).astype(np.int32), rng.integers(0, m.units + 1, 400).astype(np.int32), np.append(rng.integers(0, units, 399), units - 1).astype(np.int32)
        sys.setprofile(lambda frame, event, arg: calls.append(event))
        try:
            m.learn(one, two, target, np.random.default_rng(7))
        finally:
            sys.setprofile(None)
        return m, start, one, two, target, len(calls)

    m, start, one, two, target, calls = step(vocab.units)
    assert len({*(target // lm.PLACES).tolist()}) > 100 and abs(calls - step(2 * lm.PLACES)[-1]) < 20
    again = np.random.default_rng(7)
    drawn = again.choice(m.classes, lm.CLASS_NOISE, p=m.class_noise)
    draws = again.random((m.classes, lm.NOISE))
    slope = {name: np.zeros_like(x) for name, x in start.items()}
    for a, b, t in zip(one, two, target, strict=True):
        h, kind = np.append(start["c"][0] * start["r"][a] + start["c"][1] * start["r"][b], 1), t // lm.PLACES
        dh = np.zeros_like(h)
        noise = [kind * lm.PLACES + int((m.upto[kind] < u).sum()) for u in draws[kind]]
        for name, true, false, logs in (("k", kind, drawn, m.log_class), ("q", t, noise, m.log_inside)):
            for at, sign in [(true, 1), *((x, -1) for x in false)]:
                e = sign / (1 + np.exp(sign * (h @ start[name][at] - logs[at] - np.log(len(false)))))
                slope[name][at] += e * h / len(target)
                dh += e * start[name][at] / len(target)
        for place, x in enumerate((a, b)):
            slope["r"][x] += dh[:-1] * start["c"][place]
            slope["c"][place] += dh[:-1] * start["r"][x]
    for name, x in start.items():
        assert np.allclose(getattr(m, name), x + lm.RATE * slope[name] / np.sqrt(1e-3 + slope[name] ** 2), atol=1e-4), name
