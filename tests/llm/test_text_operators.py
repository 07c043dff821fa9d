"""Operators on single texts, urls and pages against plain Python."""

from __future__ import annotations

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import checked_packs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import html_text, packing, quality, sharding, token_counts, url_filter

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "plain words here", "a<|endoftext|>b <|endoftext|>", "tabs\t\tand \n\n lines  ", "²Ⅷ٣ é“—”\x85\xa0\x1c x", "漢字😀" * 40,
       "a" * 3000, "ab" * 2000, "don't we'll I'M", "repeat", "repeat"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BPE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def _texts(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_token_counts_equal_the_library(spark, library):
    rng = random.Random(5)
    alphabet = "ab'st re  \n\t ²٣é“—😀漢1_"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    docs = _texts(spark, texts).withColumn("n_tokens", F.lit("clash"))
    out = token_counts.with_token_counts(docs, BPE, limit=5).collect()
    assert len(out) == len(texts)
    for row in out:
        expected = len(library(row["text"]))
        assert (row["n_tokens"], row["n_bytes"], row["over_limit"]) == (expected, len((row["text"] or "").encode()), expected > 5)
    assert token_counts.with_token_counts(_texts(spark, []), BPE).count() == 0


@pytest.mark.parametrize("n_parts, fan_in", [(1, 32), (9, 2)])
def test_packing_is_an_exact_cover(spark, library, monkeypatch, n_parts, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["tion", "the", "er", "an"]) for _ in range(rng.choice([0, 3, 20, 60, 300]))) for i in range(150)}
    texts[7] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(n_parts)
    rows = packing.pack(docs, BPE, length=64, n_open=4).collect()
    n = checked_packs(rows, library, texts, 64)
    assert sum(r["length"] for r in rows) / (64 * n) > 0.85


def test_packing_of_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "same"), (None, "same"), (1, "same")], "doc_id long, text string")
    assert len(packing.pack(docs, BPE, keep_ids=False).collect()) == 3
    assert packing.pack(docs.limit(0), BPE).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"),
         ("wild.net", "/a*/z", "block"), ("", "/everywhere/", "block"), ("org", "/", "allow"), ("com", "/x", None)]


def _judge(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if v and (h == "" or host == h or host.endswith("." + h))
            and re.match(re.escape(p).replace(r"\*", ".*"), path, re.S)]
    rule = min(fits, key=lambda f: (-f[0], f[1])) if fits else (0, None, "allow")
    return host, path, rule[1], rule[2]


def test_url_rules_equal_all_rules_in_turn(spark):
    rng = random.Random(3)
    hosts = ["example.org", "WWW.Example.org", "badexample.org", "a.com", "com", "x.wild.net", "org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123?q", "/EN/1", "/de/x", "/abc/z", "/a/b/z/q", "/everywhere/1", "/x#/es/"]
    urls = [None, "", "no scheme", "http:/one.org/", "://", "a://b://org/"] + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 50, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_filter.judge_urls(pages, rules).collect()
    assert sorted(map(repr, ((r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out))) == \
        sorted(map(repr, ((u, *_judge(u)) for u in urls)))
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_shards_are_even_and_gapless(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(500)]), "x" * rng.choice([0, 10, 500, 9000])) for _ in range(2000)] + [(1, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    slotted = sharding.in_slots(docs)
    first = sharding.first_map(sharding.slot_loads(slotted), 16)
    out = sharding.placed(slotted, first, ["doc_id", "size"]).collect()
    assert len(out) == len(rows)
    bytes_of, slots_of = {}, {}
    for r in out:
        assert r["size"] == len(r["text"] or "") + 1
        bytes_of[r["shard"]] = bytes_of.get(r["shard"], 0) + r["size"]
        slots_of.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots_of.values())
    largest_slot = max(r["bytes"] for r in first.collect())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= largest_slot
    # A grown map moves slots into new shards only, and about a seventeenth of the bytes.
    grown = sharding.grown_map(first, 17).collect()
    before = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    assert all(r["shard"] in (before[r["virtual_slot"]], 16) and r["version"] == 2 for r in grown)
    moved = sum(r["bytes"] for r in grown if r["shard"] == 16)
    assert 0.5 < moved * 17 / sum(r["bytes"] for r in grown) <= 1.0
    path = str(tmp_path / "map")
    sharding.write_map(first, path)
    sharding.write_map(spark.createDataFrame(grown, first.schema), path)
    assert {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path).collect()} == {r["virtual_slot"]: r["shard"] for r in grown}
    assert {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, 1).collect()} == before
    empty = sharding.in_slots(docs.limit(0))
    assert sharding.placed(empty, sharding.first_map(sharding.slot_loads(empty), 16), ["doc_id"]).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><p>Site of things</p></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>Title  here</h1><p><b>First &amp; &quot;second&quot;
line<br>more <i>of</i> it<p>Short.</p><form><p>Your mail address please</p></form><div id="comments"><p>I think this is a very long comment of a reader.</p></div>
<p>Last with <a title="a>b" href=x>a link</a> inside of it</article><aside>Elsewhere on this site</aside><footer>&copy; us</footer>"""


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([(1, PAGE, "clash"), (2, None, ""), (3, "", ""), (4, "<!-- open", ""), (1, PAGE, "clash"), (None, "<script>x", "")],
                                  "page_id long, html string, text string")
    out = html_text.with_main_text(pages).collect()
    expected = 'Title here\nFirst & "second" line more of it\nShort.\nLast with a link inside of it'
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in out] == [(1, expected, len(expected)), (2, "", 0), (3, "", 0), (4, "", 0), (1, expected, len(expected)), (None, "", 0)]
    assert html_text.with_main_text(pages.limit(0)).count() == 0


def test_main_text_without_an_article_element():
    tree = html_text.trained()
    body = "<div>" + "word " * 80 + "</div><div>" + "more " * 90 + "</div>"
    page = f"<a href=x>Home</a><div><a href=y>News</a></div>{body}<div><a href=z>Next</a></div><div class='Cookie-notice'>{'cookie ' * 60}</div>"
    assert html_text.main_texts([page], tree) == [" ".join(["word"] * 80) + "\n" + " ".join(["more"] * 90)]
    long = "<p>" * 20000 + "x" + "<b \"" * 2000
    assert html_text.main_texts([long], tree) is not None


@pytest.mark.parametrize("between", [
    "İ" * 40 + "<script>var a;</script>", "İ" * 40 + "<STYLE>p{}</STYLE >", "<svg/>", '<svg class="icon" />', "<math/>", "<svg><path d='M0'/><title/><g/></svg>",
    "<div><button>Menu</div>", "<button>Menu", "<div><object data=x></div>", "<audio src=x>", "<datalist><option>Ah<option>Oh</datalist>", "<option>Ah",
    "<select><option>Ah<option>Oh</select>", "<button>Menu<a href=x>Go</button>", "<template><div><p>no</template>", "<video><p>No video here</video>",
    "<svg href=x/><text>no</text></svg>", "<script>'</scripty>'</script>", "<svg><svg></svg><text>no</text></svg>"])
def test_main_text_goes_on_behind_elements_without_text(between):
    page = f"<article><p>First of all.</p>{between}<p>Second, <a href=x>linked</a> and last.</p></article>"
    blocks = [b for b in html_text.blocks_of(page) if "İ" not in b[0]]
    assert [b[:3] for b in blocks] == [("First of all.", 3, 0), ("Second, linked and last.", 4, 1)]


def test_anchors_of_titles_are_no_furniture():
    tree = html_text.trained()
    said = lambda what: f"{what} is told here at some length"
    kept = {'<section id="social-history">': "section", '<h2 id="related-work">': "h2", '<p id="notice-period">': "p", "<h3 id=comments>": "h3",
            '<div id="share-price">': "div", '<div class="header-image-story">': "div", "<div class='has-sidebar text'>": "div", '<div class="entry-header">': "div", '<div id="ad-hoc-networks">': "div"}
    gone = {'<div class="ad">': "div", '<div id="comments">': "div", '<p class="share-buttons">': "p", '<div class="post related-posts">': "div",
            '<div class="Cookie-notice">': "div", '<div class="site-footer__links">': "div", '<section class="comments">': "section", '<div role="banner">': "div",
            '<div class="ad-slot-3x2">': "div", "<h2 class=sidebar>": "h2", '<div class="comment-header">': "div"}
    for tags, stays in ((kept, True), (gone, False)):
        for tag, name in tags.items():
            page = f"<article><p>{said('This')}</p>{tag}{said('That')}</{name}><p>{said('More')}</p></article>"
            assert html_text.main_texts([page], tree) == ["\n".join(map(said, ("This", "That", "More") if stays else ("This", "More")))], tag
    block = f"<h2 id='social-history'>Social history</h2><div id='notice-period'>{'word ' * 80}</div>"
    assert html_text.main_texts([f"<body><div>{'text ' * 90}</div>{block}<div>{'last ' * 90}</div>"], tree)[0].count("\n") == 3


def test_raw_text_without_end_reaches_to_the_end():
    for raw in ("script", "style", "title", "textarea", "iframe", "noscript"):
        assert [b[0] for b in html_text.blocks_of(f"<p>First</p><{raw}><p>Second</p>")] == ["First"]
    assert html_text.blocks_of("<option>x" * 50_000 + "<p>End")[-1][0] == "End"


def _quality_rows(n):
    rng = random.Random(6)
    good = ["the", "house", "stands", "near", "a", "river", "and", "people", "walk", "there", "often"]
    docs, labels = [], []
    for i in range(n):
        label = int(rng.random() < 0.7)
        words = [rng.choice(good) for _ in range(60)]
        docs.append((i, " ".join(words) + "." if label else "!! ".join(w.upper() for w in words)))
        labels.append((i, label))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = _quality_rows(600)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    d = spark.createDataFrame([*docs, (None, None), (9999, ""), *docs[:2]], "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = quality.with_scores(d.withColumn("held_out", quality.held_out()), model).collect()
    assert len(out) == 604 and {r["doc_id"] for r in out if r["held_out"]} == held | ({9999} if zlib.crc32(b"9999") % 5 == 0 else set())
    truth = dict(labels)
    right = [(r["predicted"] == truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    # Labels of held-out rows change nothing.
    turned = [(i, 1 - y if i in held else y) for i, y in labels]
    assert quality.fit(d, spark.createDataFrame(turned, "doc_id long, quality int")) == model


def test_quality_with_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, score in ((none, 1.0), (spark.createDataFrame([(1, 0), (None, 1)], none.schema), 0.0)):
        scores = [r["score"] for r in quality.with_scores(docs, quality.fit(docs, labels)).collect()]
        assert scores == pytest.approx([score, score], abs=1e-6)
    assert quality.with_scores(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_main_text_by_neighbours_and_places():
    tree = html_text.trained()
    words = lambda n, word="w": " ".join([word] * n)
    main = lambda page: html_text.main_texts([page], tree)[0]
    assert main("<html><body><div><p>Just a short page.</p></div></body></html>") == "Just a short page."
    assert main(f"<p>{words(13)}</p><p>{words(20)}</p><p>{words(10)}</p>") == "\n".join(map(words, (13, 20, 10)))
    # Without any telling name: links and labels between them go, headings and short paragraphs beside a menu stay.
    menu = "".join(f"<p><a href=x>m{i}</a></p>" for i in range(3)) + "<p>More</p><p><a href=y>last</a></p>"
    assert main(f"{menu}<h1>Head line here</h1><p>{words(9)}</p><p>{words(4)}</p>{menu}") == f"Head line here\n{words(9)}\n{words(4)}"
    article = f"<article><p>{words(60)}</p></article>"
    assert main(f"<p>Ten days left of our sale</p>{article}<p>Written by nobody</p>") == words(60)
    for name in ("user-reviews", "reader-opinions", "comments", "comment-list"):
        bad = f'<div class="{name}"><p>{words(70, "bad")}</p></div>'
        for page in (article + bad, f"<div><p>{words(60)}</p></div>{bad}", article.replace("</article>", bad + "</article>"),
                     f'<main><p>{words(60)}</p><article class="comment" id="comment-3"><p>{words(70, "bad")}</p></article></main>'):
            assert main(page) == words(60), page
    # Reviews that are no readers', and a frame named after what stands beside the main part.
    assert main(f'<article class="reviews"><p>{words(40)}</p></article>') == words(40)
    assert main(f'<div class="content-sidebar-wrap"><main><p>{words(60)}</p></main></div>') == words(60)


def test_every_linkless_block_of_an_article_stays():
    tree, rng = html_text.trained(), np.random.default_rng(5)
    size = 20_000
    count = lambda: np.where(rng.random(size) < 0.2, 0, np.exp(7 * rng.random(size)).astype(int))
    link = lambda most: most * rng.random(size)
    zero = np.zeros(size)

    def judged(own, before, behind, place):
        return html_text.judged(tree, np.stack([count(), own, count(), before, count(), behind, zero, zero, zero + place], 1))

    assert judged(link(0.4), link(1), link(1), 1).all()
    assert judged(link(0.4), link(0.4), link(0.4), 0.5).all()
    assert not judged(0.6 + link(0.4), link(1), link(1), 0.5).any()


def test_new_pre_tokens_cost_less_than_a_whole_tokenizer():
    """Each word is met for the first time: the model alone gives the library's ids, in well under its time."""
    tokenizer = Tokenizer.from_file(BPE)
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdeéß½☃\x00\xa0", k=draw.randint(4, 14))) for _ in range(20_000)]
    texts = [" ".join(words[i:i + 50]) for i in range(0, len(words), 50)]
    memo, _ = packing._memo(BPE)
    new = sorted({piece for text in texts for piece in packing.pieces(text.encode())})
    start = time.process_time()
    ids = memo.compute(new)
    middle = time.process_time()
    whole = tokenizer.encode_batch_fast([piece.decode() for piece in new], add_special_tokens=False)
    end = time.process_time()
    assert ids == [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in whole]
    assert middle - start < 0.75 * (end - middle)
    assert list(packing.encoded([t.encode() for t in texts], BPE)) == [
        b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
