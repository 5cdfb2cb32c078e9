"""Each operator against a brute-force version, and its defined results on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from sparkwright.llm import bpe, decontam, dedup, html, language, lm, search, shared, tokencounts, toxicity, urls, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
prose = lambda rng, n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(n))

# nulls, empties, white space, a very long text, repeated rows, clashing extra columns
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "one two three four five six"), (5, "x" * 30_000), (6, "word " * 30_000), (7, "Ünïcode 漢字 \x00 end")]


def frame(spark, rows):
    schema = "doc_id long, text string, score string, c0 int, label int, lang string, source string"
    return spark.createDataFrame([(i, t, "s", 1, 2, None, "src") for i, t in rows], schema)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


# --- words ---


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1cabAB1é漢", max_size=40), max_size=6))
def test_words_are_the_words(texts):
    hashes, first = words.words(*words.buffers(pa.array(texts, pa.string())))
    mine: dict[int, str] = {}
    for k, t in enumerate(texts):
        own = hashes[first[k] : first[k + 1]]
        assert len(own) == len(split(t))
        for h, w in zip(own.tolist(), split(t), strict=True):
            assert mine.setdefault(h, w) == w
    assert words.counted(*words.buffers(pa.array(texts, pa.string()))).tolist() == [len(split(t)) for t in texts]


# --- 1 ---


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '\n\t\x1c 1é.,st漢\u2003", max_size=300))
def test_bpe_pieces_do_not_change_tokens(text):
    c = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN) if not hasattr(test_bpe_pieces_do_not_change_tokens, "c") else test_bpe_pieces_do_not_change_tokens.c
    test_bpe_pieces_do_not_change_tokens.c = c
    plain = c.encoding.encode_ordinary(text)
    old = bpe.PIECE_CHARS, bpe.MERGE_BYTES
    bpe.PIECE_CHARS = 20
    try:
        assert c.encode(text) == plain
    finally:
        bpe.PIECE_CHARS, bpe.MERGE_BYTES = old
    assert c.decode(plain) == text.encode()
    for match in c.pattern.findall(text):
        assert bpe.merge(match.encode(), c.ranks) == c.encoding.encode_ordinary(match)


def test_bpe_rows(spark, codec):
    got = bpe.digests(frame(spark, ODD), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD)
    want = Counter((i, len(ids := codec.encoding.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    assert Counter(map(tuple, got)) == want
    assert bpe.digests(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_any_ids_decode(codec):
    ids = [codec.ranks[b"\xff"], codec.ranks[b"\xc3"], codec.ranks[b"a"]]
    assert codec.decode(ids) == b"\xff\xc3a"


# --- 2 ---


def test_url_parts_and_rules(spark):
    rows = [(1, None), (2, "no scheme"), (3, "https://A.Example.ORG/es/1?x#y"), (4, "http://example.org/en/12"), (5, "http://example.org"), (6, "x://notorg/"), (7, "http://m.b.com/fr/9"), (8, "http://z.net/de/5"), (8, "http://z.net/de/5"), (9, "http://shop.com/de/"), (10, "://?q")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    brief = lambda r: (r["host"], r["path"], r["rule"], r["verdict"])
    assert brief(got[1]) == brief(got[2]) == brief(got[10]) == ("", "", None, "allow")
    assert brief(got[3]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert brief(got[4]) == ("example.org", "/en/12", "example.org/en/1", "block")
    assert brief(got[5])[:3] == ("example.org", "", None)
    assert brief(got[6])[2] is None and brief(got[7])[2:] == ("com/fr/", "allow") and brief(got[9])[2:] == ("com/de/", "block")
    assert urls.judged(pages).count() == len(rows) and urls.judged(pages.limit(0)).count() == 0


def test_url_mining_equals_counting(spark):
    from itertools import combinations

    rng = random.Random(5)
    rows = [(sorted(rng.sample("abcdef", rng.randint(1, 5))), None) for _ in range(200)]
    rows = [(items, "block" if "a" in items and rng.random() < 0.95 else "allow") for items, _ in rows]
    got = {(tuple(r["tokens"]), r["verdict"]): round(r["confidence"], 9) for r in urls.mined(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.05, 0.8).collect()}
    all_rules = {}
    for k in (1, 2, 3):
        for own in combinations("abcdef", k):
            inside = [v for items, v in rows if set(own) <= set(items)]
            for v in ("allow", "block"):
                n = inside.count(v)
                if n >= 0.05 * len(rows) and n / len(inside) >= 0.8:
                    all_rules[own, v] = round(n / len(inside), 9)
    want = {(own, v): c for (own, v), c in all_rules.items() if not any(all_rules.get((less, v), 0) >= c for k in range(1, len(own)) for less in combinations(own, k))}
    assert got == want


def plain_tokens(url):
    """The tokens of a url, by string methods."""
    if not url or "://" not in url:
        rest = ""
    else:
        rest = url[url.index("://") + 3 :]
    host = re.split("[/?#]", rest)[0].translate(LOWER)
    path = re.split("[?#]", rest[len(host) :])[0]
    out, labels, steps = set(), host.split("."), [x for x in path.split("/") if x]
    if host:
        out.add("top=" + labels[-1])
    if len(labels) > 1:
        out.add("site=" + ".".join(labels[-2:]))
    out |= {"label=" + x for x in labels[:-2]} | {"step=" + x for x in steps} | {"next=" + x[0] for x in steps[1:]}
    if m := re.search(r"\.([A-Za-z0-9]{1,5})$", path):
        out.add("end=" + m[1].lower())
    if "#" in (url or ""):
        out.add("mark=yes")
    if "?" in (url or "").split("#")[0]:
        out |= {"query=" + k.split("=")[0] for k in url.split("#")[0].split("?", 1)[1].split("&") if k}
    return out


def test_mined_verdicts_of_unmatched_urls_equal_counting(spark):
    from itertools import combinations

    rng, urls_ = random.Random(21), []
    for _ in range(400):
        lang = rng.choice(["de", "fr", "es", "en", "it"])
        urls_.append(f"http://{rng.choice(['m.', 'www.a.', ''])}{rng.choice(['shop', 'blog', 'news'])}.{rng.choice(['com'] * 5 + ['net', 'org', 'example.org', 'info'])}/{lang}/{rng.randint(1, 30)}{rng.choice(['', '/deep/page.HTML', '/x?ref=1&utm=2', '#top', '?ref=9'])}")
    urls_ += ["http://z.net/de/5", "HTTP://z.net/fr/deep/page.html?utm=1", None, "no scheme?ref=1", "x://z.info/" + "long/" * 5000, "x://" + "a." * 3000 + "net/de/1?&a&=b"]
    support, confidence = 0.05, 0.7
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls_)], "page_id long, url string, items string")
    got = {r["page_id"]: r for r in urls.judged(pages, support=support, confidence=confidence).collect()}
    fixed = {r["page_id"]: r["verdict"] for r in urls.parts(pages).collect() if r["rule"]}
    labelled = [(plain_tokens(urls_[i]), v) for i, v in fixed.items()]
    rules = {}
    frequent = [t for t, n in Counter(t for own, _ in labelled for t in own).items() if n >= support * len(labelled)]
    for k in (1, 2, 3):
        for own in combinations(sorted(frequent), k):
            inside = [v for items, v in labelled if set(own) <= items]
            for v in ("allow", "block"):
                n = inside.count(v)
                if n and n >= support * len(labelled) and n / len(inside) >= confidence:
                    rules[own, v] = n / len(inside)
    rules = {(own, v): c for (own, v), c in rules.items() if not any(rules.get((less, v), 0) >= c for k in range(1, len(own)) for less in combinations(own, k))}
    seen = set()
    for i, u in enumerate(urls_):
        if i in fixed:
            assert got[i]["verdict"] == fixed[i] and got[i]["mined_tokens"] is None
            continue
        fits = {c for (own, v), c in rules.items() if set(own) <= plain_tokens(u)}
        if not fits:
            assert got[i]["verdict"] == "allow" and got[i]["mined_tokens"] is None
        else:
            own = tuple(got[i]["mined_tokens"])
            assert abs(got[i]["mined_confidence"] - max(fits)) < 1e-9 and abs(rules[own, got[i]["verdict"]] - max(fits)) < 1e-9
        seen.add((got[i]["verdict"], bool(fits)))
    assert {("allow", True), ("block", True), ("allow", False)} <= seen and len(got) == len(urls_)
    old, urls.MOST_BROADCAST = urls.MOST_BROADCAST, 0  # the index joined by shuffle
    try:
        assert {r["page_id"]: r for r in urls.judged(pages, support=support, confidence=confidence).collect()} == got
    finally:
        urls.MOST_BROADCAST = old


def test_url_parts_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    want = sorted(c.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.PARTS_SQL})").fetchall(), key=str)
    assert sorted(map(tuple, urls.url_parts(spark, "/root/testdata/sf0.01").collect()), key=str) == want


# --- 3 ---


def shingle_set(text):
    w = split(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("large", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, large):
    if large:  # what large inputs do: ids beyond the filter, chunks of hot buckets, keys joined by shuffle
        monkeypatch.setattr(dedup, "MOST_FILTER_BITS", 64)
        monkeypatch.setattr(dedup, "CHUNK", 3)
        monkeypatch.setattr(dedup, "MOST_BROADCAST", 0)
    rng, rows = random.Random(3), []
    for _ in range(6):
        base = prose(rng, rng.randint(30, 200)).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(10_000 + i, prose(rng, rng.randint(1, 60))) for i in range(60)] + [(20_000, "a b c"), (20_001, "A  b\nC"), (20_002, "a b")]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(frame(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want
    assert sorted(r["doc_id"] for r in dedup.kept_documents(frame(spark, rows + rows[:40])).collect()) == sorted(i for i, (_, root) in want.items() if i == root)


def test_near_duplicates_odd_rows(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in dedup.near_duplicates(frame(spark, [*ODD, (8, "one")])).collect()]
    assert len(got) == len(ODD) + 1
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (8, 1, 4, False)} <= set(got) and got.count((4, 1, 4, True)) == 2
    kept = dedup.kept_documents(frame(spark, [*ODD, (None, ODD[5][1]), (8, "one")]))
    assert kept.columns == frame(spark, []).columns and kept.count() == len(ODD)  # both null ids stay, one of (4, "one") goes
    assert dedup.kept_documents(frame(spark, [])).count() == 0
    assert dedup.near_duplicates(frame(spark, [])).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (dedup.sketch(a) != ~np.uint64(0)).all()
    a, b = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    same = (dedup.sketch(a) == dedup.sketch(np.concatenate([a[:320], b[:80]]))).mean()
    assert abs(same - 320 / 480) < 0.17


# --- 4 ---


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, k + 1 if k < 5 else rng.randint(3, 50))) for k in range(12)] + [(50, None), (51, ""), (52, "alpha beta gamma")]
    docs = []
    for i in range(40):
        own = prose(rng, rng.randint(0, 80)).split()
        if i % 2:
            item = rng.choice(items[:12])[1].split()
            if i % 4 == 1 and len(item) > 40:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(own))
            own[at:at] = item
        docs.append((i, " ".join(own)))
    docs += [(100, "x y z Alpha beta\ngamma w v u t"), (101, "alpha beta gamma"), (102, "alpha beta"), (103, "alpha beta x gamma " * 50), (104, prose(rng, 9000) + " " + " ".join(items[11][1].split()[:-2]))]

    def grams(w, unit):
        return Counter(tuple(w[k : k + unit]) for k in range(len(w) - unit + 1)) if len(w) >= unit else Counter([tuple(w)]) if w else Counter()

    want = {}
    for i, t in docs:
        w = split(t)
        for k, item in items:
            m = split(item)
            unit = min(5, max(1, len(m)))
            own = grams(m, unit)
            best = 0
            for s in range(max(1, len(w) - len(m) + 1)):
                g = grams(w[s : s + len(m)], unit)
                if m and sum((g | own).values()):
                    best = max(best, sum((g & own).values()) / sum((g | own).values()))
            if best >= 0.75:
                want[i, k] = round(best, 9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    assert got == want and want
    assert {r["doc_id"] for r in decontam.clean_documents(frame(spark, docs), bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontam.contaminated(frame(spark, ODD), bench).count() == 0 and decontam.clean_documents(frame(spark, ODD), bench).count() == len(ODD)
    assert decontam.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_hamming_index_proposes_all_within_the_radius_and_few_others():
    rng = np.random.default_rng(2)
    index = decontam.Index([(k, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 40))) for k in range(60)])
    bits = np.unpackbits(index.prints.astype("<u2").view(np.uint8), axis=1, bitorder="little")
    for _ in range(200):
        k, turned = int(rng.integers(60)), bits[0].copy()
        turned = bits[k].copy()
        turned[rng.choice(256, decontam.RADIUS, replace=False)] ^= 1
        prints = np.packbits(turned[None], axis=1, bitorder="little").view("<u2").astype(np.uint32)
        assert decontam.apart(prints[0], index.prints[k]) == decontam.RADIUS
        assert any(k in item for _, item in index.proposals(0, prints))
    strange = rng.integers(0, 1 << 16, (500, decontam.BLOCKS)).astype(np.uint32)
    share = sum(len(w) for w, _ in index.proposals(0, strange)) / (500 * 60)
    assert 0.12 < share < 0.2


def test_windows_at_the_least_similarity_are_recalled():
    rng, found, total = np.random.default_rng(5), 0, 0
    for size in (12, 30, 60, 150, 400):
        for _ in range(60):
            words = [f"w{x}" for x in rng.integers(0, 10**9, size)]
            index = decontam.Index([(1, " ".join(words))])
            changed, n = list(words), size - 4
            for _ in range(50):  # as many words changed as the similarity allows
                trial = list(changed)
                trial[int(rng.integers(size))] = f"x{rng.integers(10**9)}"
                both = len({tuple(words[k : k + 5]) for k in range(n)} & {tuple(trial[k : k + 5]) for k in range(n)})
                if both * 100 >= (2 * n - both) * 75:
                    changed = trial
            total += 1
            text = " ".join([*(f"y{x}" for x in rng.integers(0, 10**9, 30)), *changed])
            found += len(list(decontam.scan(pa.array([text]), index)))
    assert found == total


# --- 5 ---


def test_html(spark):
    model = html.train()
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Head</h1><p>First &amp; <b>bold</b>\n text, long enough to read.</p><script>var t="</p>";</script><div class="advert"><p>Advert here.</p></div><p>Second para goes on and on, with a <a href=y>link</a>.</article><section class="comments"><div class="comment"><p>Nice one, I say.</p></div></section><footer>&copy; me</footer></body></html>'
    assert html.Extractor(model).text(page) == "Head\nFirst & bold text, long enough to read.\nSecond para goes on and on, with a link."
    right = total = 0
    for p, truth in html.labelled_pages(60, seed=123):
        want = Counter(t for t, main in truth if main)
        got = Counter(html.Extractor(model).text(p).split("\n"))
        right, total = right + sum((want & got).values()), total + max(sum(want.values()), sum(got.values()))
    assert right / total > 0.95
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "<div <p> 'x"), (5, "u", "<p>" * 5000), (6, "u", page), (6, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html.extracted(rows, model).collect()
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["page_id"] in (1, 2, 5)} == {""}


def test_html_only_scripts_and_styles_are_hidden():
    texts = lambda page: [t for t, *_ in html.leaf_blocks(page)]
    assert texts('<article><p>one <svg class="i"/> two</p><p>three</p></article>') == ["one two", "three"]
    assert texts("<p>a <math/> b <object data='x'/> c <SVG/> d</p><p>e</p>") == ["a b c d", "e"]
    assert texts("<select-box>one</select-box><p>two</p><object-x>three</object-x><template-x>four</template-x>") == ["one", "two", "three", "four"]
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then <object><param name=a>plain</object> text</p>") == ["if x=1 then plain text"]
    assert texts("<p>a<svg viewBox='0 0 1 1'><text>x</text></svg><script>no</script><select><option>one</select>b</p><style/>no</style>c") == ["ax", "one", "b", "c"]
    assert texts("<article><noscript><p>kept</p></noscript><template>also</template></article>") == ["kept", "also"]
    assert texts("<p>a<!-- no <p>x</p> --><!-- open <p>no</p>") == texts("<p>a<script>no <p>x</p>") == texts("a <!-- no") == ["a"]
    assert texts("a <b c") == ["a <b c"] and texts("&#" + "9" * 5000 + ";&#x110000;") == ["\ufffd\ufffd"] and texts("&amp;lt; &#65;") == ["&lt; A"]


@pytest.mark.parametrize("page", ["<a " * 700_000, "<div>x" * 350_000, "<div>" * 200_000 + "</p>" * 200_000, "<a '>" * 400_000, '<a "' * 500_000 + ">", "<script>" + "</script " * 250_000, "".join(f"<div class='n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>t" for i in range(80_000))], ids=range(7))
def test_html_time_follows_the_length(page):
    import time

    e, began = html.Extractor(html.train(steps=3)), time.process_time()
    e.text(page)
    assert time.process_time() - began < 8  # about 2 MB; a quadratic scan takes minutes


def test_html_articles_of_the_given_pages(spark):
    """Against an independent parser that knows these pages' layout: the blocks of their article."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag == "br":
                self.blocks[-1] += " "
            elif tag != "b":
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag != "b":
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in html.op5(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        assert got[r["page_id"]] == "\n".join(" ".join(b.split()) for b in parser.blocks if b.split())
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int, n_chars string")
    assert html.extracted(empty, html.train(steps=2)).count() == 0


def test_viterbi_is_the_best_path():
    model = html.train()
    e = html.Extractor(model)
    page, _ = next(html.labelled_pages(1, seed=4))
    blocks = html.leaf_blocks(page)[:8]
    gains = [sum(model["weights"].get(f, 0.0) for f in own) for own in html.features(blocks)]

    def value(path):
        v = model["start"][path[0]] + model["end"][path[-1]] + sum(g for g, s in zip(gains, path, strict=True) if s)
        return v + sum(model["move"][a][b] for a, b in zip(path[:-1], path[1:], strict=True))

    paths = [[n >> k & 1 for k in range(len(blocks))] for n in range(1 << len(blocks))]
    assert abs(value([int(x) for x in e.main_blocks(blocks)]) - max(map(value, paths))) < 1e-9


# --- 6 ---


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identified(docs, language.trained(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    model = language.fit([("the cat sat on the mat the cat", "en"), ("le chat est sur le tapis le chat", "fr")])
    odd = language.identified(frame(spark, [*ODD, (9, "123 !!"), (10, "le chat")]), model).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert by[1] == by[2] == by[9] == "und" and by[10] == "fr" and len(odd) == len(ODD) + 2
    assert {r["lang_pred"] for r in language.identified(frame(spark, ODD), language.fit([])).collect()} == {"und"}
    assert language.known_language(frame(spark, [(9, "123"), (10, "le chat")]), model).count() == 1


def test_backoff_goes_to_shorter_grams():
    s = language.Scorer(language.fit([("abcdef abcdef gh", "x"), ("uvwxyz uvwxyz", "y")]))

    def cost(word):
        costs, known = s.looked_up(word, np.array([0]), np.array([len(word)]))
        return list(costs[0]) if known[0] else None

    assert np.allclose(cost("abcdef"), [-math.log10(2 / 3), 7.0]) and cost("gh") != cost("abcdef")
    assert cost("abcdeq")[0] < cost("abcdeq")[1] and cost("qa")[0] < cost("qa")[1]
    assert cost("qq") is None and s.predict("漢字 qq") == ("x", 0.0)  # the frame is no evidence
    assert s.predict("漢字 qq uvw")[0] == "y"


def test_language_by_plain_loops(spark):
    """Words, costs and scores, word by word."""
    import regex

    rng = random.Random(14)
    alphabets = {"aa": "abcde\u0301fé", "bb": "defghß", "hi": "नमस्तेदुनिया"}
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 7))) for _ in range(n))
    rows = [(text(alphabets[k], rng.randint(1, 40)), k) for k in alphabets for _ in range(30)]
    model = language.fit(rows)
    word = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    counts = {k: Counter(w for t, l in rows if l == k for w in word.findall(t.lower())) for k in alphabets}

    def table(n):
        out = {}
        for k, c in counts.items():
            own = Counter()
            for w, m in c.items():
                f = f" {w} "
                for g in [w] if n == 0 else [f[i : i + n] for i in range(len(f) - n + 1) if f[i : i + n] != " "]:
                    own[g] += m
            out[k] = {g: min(7.0, -math.log10(m / sum(own.values()))) for g, m in own.items() if m > 1}
        return out

    tables = {n: table(n) for n in range(6)}

    def cost(w):
        f = f" {w} "
        for n in (0, 5, 4, 3, 2, 1):
            parts = [w] if n == 0 else [f[i : i + n] for i in range(len(f) - n + 1)]
            known = [g for g in parts if any(g in tables[n][k] for k in counts)]
            if known:
                return [sum(tables[n][k].get(g, 7.0) for g in known) / len(known) for k in sorted(counts)]
        return None

    def predict(t):
        own = word.findall((t or "").lower())
        if not own:
            return "und", 0.0
        known = [c for w in own if (c := cost(w))]
        if not known:
            return "aa", 0.0
        mean = [sum(x) / len(known) for x in zip(*known, strict=True)]
        best = min(range(3), key=lambda k: mean[k])
        return sorted(counts)[best], 1 / sum(10 ** ((mean[best] - m) * min(len(known), 20)) for m in mean)

    texts = [t for t, _ in rows[::5]] + [text(a + "xyz1 \u0301-", 30) for a in alphabets.values() for _ in range(8)] + [None, "", "\u0301\u0301 12", "漢字", "A\u0301B \u0301c", "नमस्ते दुनिया", "bé " * 9000, "İI ẞ"]
    texts += ["q" * 3000 + f" {k} ab" for k in range(3)]
    got = {r["doc_id"]: r for r in language.identified(frame(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        lang, score = predict(t)
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["lang_pred"] == lang, t
    old, language.SLICE_CHARS = language.SLICE_CHARS, 40  # many slices
    try:
        again = language.Scorer(model).predict_all(texts[:40])
    finally:
        language.SLICE_CHARS = old
    assert [(l, round(s, 9)) for l, s in again] == [(got[i]["lang_pred"], round(got[i]["score"], 9)) for i in range(40)]
    assert language.identified(frame(spark, []), model).count() == 0 and language.known_language(frame(spark, []), model).count() == 0


# --- 7 ---


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.choice([0.0, 0.5, -0.25, 1.0], 6)]) for i in range(0, 260)]
    rows += [(50, [float("nan")] * 6), (400, None), (450, [0.1, None]), (500, [1.0] * 6), (550, [1.0] * 6), (None, [1.0] * 6)]
    rows += [(100, [1.0] * 6), (100, [1.0] * 6), (100, [0.5] * 6), (7, [1.0] * 6), (7, [1.0] * 6), (600, [2.0, 2.0]), (650, [])]  # repeated queries and candidates, other lengths
    table = search.quantised(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int"))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for a, (i, q) in enumerate(good):
        if i % 50 == 0:
            found = sorted((-int(q[: len(c)] @ c[: len(q)]), j) for b, (j, c) in enumerate(good) if a != b)[:5]
            want.update((i, r, j, -s) for r, (s, j) in enumerate(found, 1))
    for chunk, block, dense in ((search.CHUNK_BYTES, search.BLOCK_BYTES, search.SCORE_BYTES), (300, 200, 100)):
        old = search.CHUNK_BYTES, search.BLOCK_BYTES, search.SCORE_BYTES
        search.CHUNK_BYTES, search.BLOCK_BYTES, search.SCORE_BYTES = chunk, block, dense
        try:
            got = Counter(map(tuple, search.top_k(table.filter("vec_id % 50 = 0"), table).collect()))
        finally:
            search.CHUNK_BYTES, search.BLOCK_BYTES, search.SCORE_BYTES = old
        assert got == want
    assert search.top_k(table.limit(0), table.limit(0)).count() == 0
    one = table.filter("vec_id = 500")
    assert search.top_k(one, one).count() == 0


# --- 8 ---


def test_lm_base_score_and_normalisation(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(120)] + ODD
    got = lm.scored(frame(spark, rows), share=0.002).collect()
    assert len(got) == len(rows)
    tokens = [(i, [*split(t), None]) for i, t in rows]
    c = Counter()
    for i, w in tokens:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.scored(frame(spark, [])).count() == 0


def test_lm_keeps_every_ngram(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    train = [split(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    ids = {w: k for k, w in enumerate(sorted({w for t in train for w in t}), 2)}
    size = len(ids) + 2
    ones, double, triple = np.zeros(size, np.int64), Counter(), Counter()
    for t in train:
        way = [lm.START, *(ids[w] for w in t), lm.END]
        np.add.at(ones, way, 1)
        double.update(a * size + b for a, b in zip(way, way[1:], strict=False))
        triple.update((a * size + b) * size + d for a, b, d in zip(way, way[1:], way[2:], strict=False))
    assert min(triple.values()) == 1
    whole = lm.Automaton(ones, double, triple, int(ones[1:].sum()), size - 1)
    monkeypatch.setattr(lm, "BLOCK", 400)  # several blocks and ranges
    monkeypatch.setattr(lm, "ENTRIES", 60)
    got = {r["doc_id"]: r["score"] for r in lm.scored(frame(spark, rows).repartition(5, "doc_id")).collect()}
    assert len(got) == len(rows)
    assert all(abs(got[i] - whole.traverse([*(ids[w] for w in split(t)), lm.END])) < 1e-6 for i, t in rows)


def test_automaton_sums_to_one_and_follows_counts():
    rng = random.Random(8)
    texts = [[rng.randint(2, 6) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    size, ones, double, triple = 7, np.zeros(7, np.int64), Counter(), Counter()
    for t in texts:
        ids = [lm.START, *t, lm.END]
        for w in ids:
            ones[w] += 1
        double.update(a * size + b for a, b in zip(ids, ids[1:], strict=False))
        triple.update((a * size + b) * size + d for a, b, d in zip(ids, ids[1:], ids[2:], strict=False))
    double, triple = {k: n for k, n in double.items() if n > 1}, {k: n for k, n in triple.items() if n > 2}
    n, v = int(ones[1:].sum()), 6
    a = lm.Automaton(ones, double, triple, n, v)

    def p(history, w):
        base = (ones[w] + 0.5) / (n + 0.5 * (v + 1))
        if len(history) >= 1:
            h = history[-1]
            own = {k % size: x for k, x in double.items() if k // size == h}
            if own:
                kept = {x: (m - lm.DISCOUNT) / ones[h] for x, m in own.items()}
                base = kept.get(w, 0) + (1 - sum(kept.values())) * base
        if len(history) >= 2:
            g, h = history[-2:]
            own = {k % size: x for k, x in triple.items() if k // size == g * size + h}
            if own:
                kept = {x: (m - lm.DISCOUNT) / double[g * size + h] for x, m in own.items()}
                base = kept.get(w, 0) + (1 - sum(kept.values())) * base
        return base

    unknown = 0.5 / (n + 0.5 * (v + 1))
    for t in texts[:20]:
        ids = [lm.START, *t, lm.END]
        assert abs(a.traverse(ids[1:]) - sum(math.log10(p(ids[max(0, k - 2) : k], ids[k])) for k in range(1, len(ids)))) < 1e-9
    for state in range(len(a.arcs)):
        total = 0.0
        for w in range(1, size):
            s, cost = state, 0.0
            while w not in a.arcs[s]:
                s, cost = a.fail[s], cost + a.cost[s]
            total += 10 ** (cost + a.arcs[s][w][1])
        assert abs(total + unknown * 10 ** a.down[state] - 1) < 1e-9


# --- 9 ---


def test_token_counts(spark, tmp_path, codec):
    rng = np.random.default_rng(7)
    old = tokencounts.SPAN, tokencounts.RANGE_BLOCKS, tokencounts.TASK_RANGES
    tokencounts.SPAN, tokencounts.RANGE_BLOCKS, tokencounts.TASK_RANGES = 3, 2, 2
    try:
        for kind, width in (("<u2", 2), ("<u4", 4)):
            want, at = {}, tmp_path / kind[1:]
            at.mkdir()
            for f, high in enumerate((2, 6, 60, 600)):
                ids = rng.integers(0, high, 700).astype(kind)
                ids.tofile(at / f"f{f}.bin")
                parts = np.split(ids, np.flatnonzero(ids == 1) + 1)
                want[f"f{f}.bin"] = [(len(x) - 1, True) if k < len(parts) - 1 else (len(x), False) for k, x in enumerate(parts) if k < len(parts) - 1 or len(x)]
            (at / "empty.bin").write_bytes(b"")
            got: dict[str, list] = {}
            for r in tokencounts.token_counts(spark, str(at), 1, width, 16).orderBy("file", "document").collect():
                assert r["document"] == len(got.setdefault(r["file"].rpartition("/")[2], []))
                got[r["file"].rpartition("/")[2]].append((r["n_tokens"], r["closed"]))
            assert got == want
        rows = tokencounts.documents_counted(frame(spark, ODD).repartition(3), RANKS, public_tokenizers.PATTERN).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((i, len(codec.encode(t))) for i, t in ODD)
        assert tokencounts.documents_counted(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    finally:
        tokencounts.SPAN, tokencounts.RANGE_BLOCKS, tokencounts.TASK_RANGES = old
    with pytest.raises(ValueError, match="id of a token"):
        tokencounts.documents_counted(frame(spark, ODD), RANKS, public_tokenizers.PATTERN, 100)
    with pytest.raises(Exception, match="whole number"):
        (tmp_path / "odd.bin").write_bytes(b"abc")
        tokencounts.token_counts(spark, str(tmp_path / "odd.bin")).collect()


# --- 10 ---


def test_toxicity(spark):
    rng = random.Random(10)
    bad = ["grumblefink", "snorkwaddle", "blitherskite"]
    rows = []
    for i in range(400):
        w = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], x) for x in prose(rng, rng.randint(5, 40)).split()]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((" ".join(w), int(toxic)))
    model = toxicity.fit(rows[:300])
    judge = toxicity.Judge(model)
    assert ((judge.scores([t for t, _ in rows[300:]]) >= 0.5) == np.array([y == 1 for _, y in rows[300:]])).mean() > 0.97
    assert (judge.scores(["you grum-ble-fink", "you g r u m b l e f i n k", "you snorkxwaddle now", "blither_skite!"]) >= 0.5).all()
    assert (judge.scores(["", "a b", "alphab betac gammad"]) < 0.5).all()
    got = toxicity.scored(frame(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in toxicity.scored(frame(spark, ODD), toxicity.fit([])).collect()} == {0.0}
    assert toxicity.civil_documents(frame(spark, [*ODD, (11, "a snorkwaddle b")]), model).count() == len(ODD)


def test_unit_scores_are_the_kernel():
    """The table look-up equals the subsequence kernel summed over landmarks, by plain loops."""
    rng = np.random.default_rng(3)
    u, l = (rng.integers(1, 5, n).astype(np.uint8) for n in (9, 6))

    def phi(x):
        out = Counter()
        for i in range(len(x)):
            for b in range(2, toxicity.SPAN + 1):
                for a in range(1, b):
                    if i + b < len(x):
                        out[(int(x[i]) << 2 * toxicity.BITS) | (int(x[i + a]) << toxicity.BITS) | int(x[i + b])] += toxicity.DECAY ** (b - 2)
        return out

    table = np.zeros(1 << 3 * toxicity.BITS, np.float32)
    for k, w in phi(l).items():
        table[k] = w
    want = sum(w * table[k] for k, w in phi(u).items()) / toxicity.norms(9)[9]
    assert abs(toxicity.unit_scores(u, np.array([0]), table, toxicity.norms(9))[0] - want) < 1e-4


def test_toxicity_in_other_scripts():
    """Words of one length in one script are told apart."""
    rng = random.Random(12)
    letters = "абвгдежзиклмнопрстуфхцч"
    clean = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(80)]
    bad, rows = ["идиот", "дурак"], []
    for i in range(300):
        w = [rng.choice(clean) for _ in range(rng.randint(4, 25))]
        if i % 3 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((" ".join(w[:8]) + ". " + " ".join(w[8:]), int(i % 3 == 0)))
    judge = toxicity.Judge(toxicity.fit(rows[:200]))
    assert ((judge.scores([t for t, _ in rows[200:]]) >= 0.5) == np.array([y == 1 for _, y in rows[200:]])).mean() > 0.97
    assert list(judge.scores(["идиот", "и д и о т", "кошка", clean[0]]) >= 0.5) == [True, True, False, False]


def test_toxicity_scores_by_plain_loops(spark):
    """Whole texts through the operator against the kernel expansion of the highest unit, unit by unit."""
    rng = random.Random(13)
    rows = [(f"alpha beta{'' if i % 2 else ' grumblefink'} " + re.sub(r"\d", "x", prose(rng, 6)), 1 - i % 2) for i in range(80)]
    model = toxicity.fit(rows)
    weight = dict(zip(model["codes"].tolist(), model["weights"].tolist(), strict=True))

    def score(text):
        words, run = [], ""
        for w in [*re.split(r"[ \n\t]+", re.sub(r"[.!-]", "", (text or "").lower())), "end of all"]:
            if len(w) == 1:
                run += w
                continue
            words += [x for x in (run, w) if x and w != "end of all" or x == run and x]
            run = ""
        best = -math.inf
        for w in words:
            x = [int(toxicity.classes()[ord(c)]) for c in w]
            total = square = 0.0
            for i in range(len(x)):
                for b in range(2, toxicity.SPAN + 1):
                    for a in range(1, b):
                        if i + b < len(x):
                            k = toxicity.DECAY ** (b - 2)
                            total += k * weight.get((x[i] << 2 * toxicity.BITS) | (x[i + a] << toxicity.BITS) | x[i + b], 0.0)
                            square += k * k
            if square:
                best = max(best, total / math.sqrt(square))
        return 1 / (1 + math.exp(-(model["a"] * (best if best > -math.inf else -1.0) + model["b"])))

    texts = [t for t, _ in rows[:20]] + [None, "", "a b", "g r u m b l e f i n k", "grum-blefink! so", "grumblexfink", "x" * 3000, ("alpha " * 4000) + "grumblefink"]
    got = {r["doc_id"]: r for r in toxicity.scored(frame(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i]["score"] - score(t)) < 1e-4 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    assert toxicity.scored(frame(spark, []), model).count() == 0 and toxicity.civil_documents(frame(spark, []), model).count() == 0


def test_a_sample_is_bounded_in_rows_and_keys(spark):
    rows = frame(spark, [(7, f"t{k}") for k in range(50)] + [(8, "a"), (9, None), (10, "b")]).select("doc_id", "text", "lang")
    got = shared.chosen(rows, "doc_id", 3).collect()
    assert len(got) == 3 and len({r["doc_id"] for r in got}) == 3 and all(r["text"] == "t0" for r in got if r["doc_id"] == 7)
    assert sorted(r["doc_id"] for r in shared.chosen(rows, "doc_id", 100).collect()) == [7, 8, 9, 10]
    assert shared.chosen(rows.limit(0), "doc_id", 3).count() == 0


# --- all together ---


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in P.STAGES][0] == "toxicity" and len(P.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in P.run(spark, sf).collect()}
    stay = {r["doc_id"] for r in toxicity.scored(docs, toxicity.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))).filter("predicted = 0").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.filter(F.col("doc_id").isin(list(stay))).collect()]
    firsts = {i for i, (_, root) in brute_components(rows).items() if i == root}
    left = docs.filter(F.col("doc_id").isin(list(firsts)))
    leaks = {r["doc_id"] for r in decontam.contaminated(left, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids == firsts - leaks and ids


def test_pipeline_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(22)
    given_docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = [(r["doc_id"] + 1000, r["text"], r["lang"]) for r in given_docs.collect()]
    odd = [(i, t, None) for i, t in ODD] + [(900 + k, prose(rng, 40), "en") for k in range(3)]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x") for i, t, lang in odd + plain], "doc_id long, text string, lang string, source string, n_chars long, c0 int, score string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, some in ((rows, True), (rows.limit(0), False)):
        for name, stage in P.STAGES:
            got = stage(spark, docs, str(tmp_path))
            assert name == P.STAGES[-1][0] or got.schema == docs.schema
            if some:
                n, before = got.count(), docs.count()
                assert n == before if name in ("toxicity", "benchmark decontamination", "byte-level BPE") else 0 < n < before  # without labels and items nothing goes
                if name == "language ID":
                    assert not {1, 2, 3} & {r["doc_id"] for r in got.collect()}
            else:
                assert got.count() == 0
            if name != P.STAGES[-1][0]:
                docs = spark.createDataFrame(got.toArrow(), docs.schema)


def test_search_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(c.execute(f"SELECT query_id, rank, vec_id, score FROM ({search.OP7_SQL})").fetchall())
    assert sorted(map(tuple, search.op7(spark, "/root/testdata/sf0.001").collect())) == want
