"""BPE, token counts, GIF media and HTML text, each against the library, an exact round trip or brute force."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import pytest

from quire.llm import bpe, gif, htmltext, wordpiece
from tests.llm.conftest import same, sample_texts


@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(4)
    letters = "aA bé\n\t'sLl0๑٣ 你🙂\u00a0 ́_!ǅ²Ⅷ\x1c\x85\u180e\u3000'tré"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    return out + ["<|endoftext|>", "a<|endoftext|>  b <|endoftext|>", "  <|endoftext|>", " " * 50, "x" * 20_000, "don't  we'll"]


def test_bpe_equals_the_library(spark, vocab, library):
    texts = odd_texts() + sample_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in bpe.encode(frame, vocab).collect()} == want
    decoded = bpe.decode(bpe.encode(frame, vocab), vocab)
    assert {r.doc_id: r.text for r in decoded.collect()} == {i: library.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, ids in want.items()]
    assert same(bpe.digests(frame, vocab).collect(), rows)


def test_pair_tree_against_a_scan():
    rng = random.Random(9)
    for _ in range(200):
        ranks = [rng.choice([bpe._NONE, rng.randrange(6)]) for _ in range(rng.randrange(1, 40))]
        tree = bpe.PairTree(list(ranks))
        for _ in range(20):
            i = rng.randrange(len(ranks))
            ranks[i] = rng.choice([bpe._NONE, rng.randrange(6)])
            tree.set(i, ranks[i])
            low = min(ranks)
            assert tree.best() == (low, ranks.index(low) if low != bpe._NONE else -1)


def test_bpe_edges(docs, wide_docs, no_docs, vocab):
    assert same(bpe.digests(docs, vocab).collect(), bpe.digests(wide_docs, vocab).collect())
    assert bpe.digests(no_docs, vocab).collect() == []
    assert bpe.decode(bpe.encode(no_docs, vocab), vocab).collect() == []


def greedy(word, vocabulary):
    n = i = 0
    longest = max(map(len, vocabulary))
    while i < len(word):
        j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in vocabulary), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(6)
    for _ in range(60):
        vocabulary = {bytes(rng.choices(b"abcd", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 15))}
        a = wordpiece.Automaton(sorted(vocabulary))
        for _ in range(60):
            w = bytes(rng.choices(b"abcde", k=rng.randrange(1, 14)))
            assert a.count(w) == greedy(w, vocabulary)


def test_token_counts(docs, wide_docs, no_docs, vocab):
    vocabulary = set(wordpiece.pieces_of(vocab.value))
    want = []
    for r in docs.collect():
        each = [greedy(b" " + w, vocabulary) for w in (r.text or "").encode().split()]
        want.append((r.doc_id, len(each), sum(each), max(each, default=0)))
    assert same(wordpiece.token_counts(docs, vocab).collect(), want)
    assert same(wordpiece.token_counts(wide_docs, vocab).collect(), want)
    assert wordpiece.token_counts(no_docs, vocab).collect() == []


def test_lzw_of_very_short_runs():
    for run in ([256], [256, 65]):
        bits = "".join(format(c, "09b")[::-1] for c in [*run * 100_000, 66, 257])
        data = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
        want = b"A" * (100_000 * (len(run) - 1)) + b"B"
        begin = time.perf_counter()
        assert gif.lzw_decode(data, 8, len(want)) == want and time.perf_counter() - begin < 2


def test_lzw_round_trips():
    rng = random.Random(8)
    for n in (0, 1, 2, 5000, 40_000):
        for data in (os.urandom(n), bytes(n), bytes(rng.choices(b"ab", k=n))):
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data
    for bits in range(2, 9):
        data = bytes(rng.choices(range(1 << bits), k=20_000))
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def handmade(frames, size=(3, 2), palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    """A GIF of (left, top, w, h, indices, disposal, transparent, interlaced) frames, two bits a sample."""
    out = [b"GIF89a", size[0].to_bytes(2, "little"), size[1].to_bytes(2, "little"), b"\x81\0\0", bytes(v for c in palette for v in c), b"\x21\xfe\x02hi\0"]
    for left, top, w, h, indices, disposal, transparent, interlaced in frames:
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (transparent is not None)]), (7).to_bytes(2, "little"), bytes([transparent or 0]), b"\0"]
        out += [b"\x2c", *(v.to_bytes(2, "little") for v in (left, top, w, h)), bytes([0x40 if interlaced else 0]), b"\x02"]
        stream = gif.lzw_encode(bytes(indices), 2)
        out += [bytes([len(stream)]), stream, b"\0"]
    return b"".join([*out, b"\x3b"])


def test_gif_disposal_and_transparency():
    data = handmade([(0, 0, 3, 2, [0] * 6, 1, None, False), (1, 0, 2, 1, [1, 2], 2, 2, False), (0, 1, 1, 1, [3], 3, None, False), (0, 0, 1, 1, [1], 0, None, False)])
    shown = [f.canvas[..., :3].reshape(-1, 3).tolist() for f in gif.decode(data)]
    red, green, grey, none = [255, 0, 0], [0, 255, 0], [9, 9, 9], [0, 0, 0]
    assert shown[0] == [red] * 6
    assert shown[1] == [red, green, red, red, red, red]  # the third sample is transparent
    assert shown[2] == [red, none, none, grey, red, red]  # the second frame's area was cleared
    assert shown[3] == [green, none, none, red, red, red]  # the third frame was taken back
    assert [f.start_cs for f in gif.decode(data)] == [0, 7, 14, 21]


def test_gif_interlacing():
    rows = [[k % 4] * 2 for k in range(11)]
    order = [*range(0, 11, 8), *range(4, 11, 8), *range(2, 11, 4), *range(1, 11, 2)]
    (frame,) = gif.decode(handmade([(0, 0, 2, 11, [v for k in order for v in rows[k]], 0, None, True)], (2, 11)))
    assert frame.indices.tolist() == rows


def test_gif_columns(docs, wide_docs, no_docs):
    got = {(r.doc_id, r.n_bytes): r for r in gif.digests(docs).collect()}
    for r in docs.collect():
        text = (r.text or "").encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        g = got[r.doc_id, len(text)]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert same(gif.digests(wide_docs).collect(), gif.digests(docs).collect())
    assert gif.digests(no_docs).collect() == []
    stored = gif.store(docs).where("doc_id is not null")
    for r in gif.frames(stored).where("frame is not null").groupBy("doc_id").agg({"samples": "count"}).collect():
        assert r[1] >= 1
    samples = {}
    for r in gif.frames(stored.dropDuplicates(["doc_id"])).orderBy("doc_id", "frame").collect():
        samples[r.doc_id] = samples.get(r.doc_id, b"") + bytes(r.samples)
        assert sum(r.histogram) > 0 and r.error is None
    assert all(samples[r.doc_id].rstrip(b" ") == (r.text or "").encode().rstrip(b" ") for r in docs.where("doc_id is not null").collect())


def test_damaged_gifs(spark):
    good = gif.encode_samples(gif.payload_of(b"hello"))
    rows = [(1, None), (2, b""), (3, b"GIF89a"), (4, good[:-40]), (5, good)]
    got = {r.doc_id: r.error for r in gif.frames(spark.createDataFrame(rows, "doc_id bigint, gif binary")).collect()}
    assert got[5] is None and all(got[i] for i in (1, 2, 3, 4))


def test_gif_screens_and_frames_that_only_declare_size(spark):
    screen = (60_000).to_bytes(2, "little")
    good = handmade([(0, 0, 3, 2, [0] * 6, 1, None, False)])
    wide = good[:6] + screen + screen + good[10:]  # a large screen of which a frame covers little
    (frame,) = gif.decode(wide)
    assert frame.canvas.shape == (2, 3, 4) and gif.histogram(frame.canvas).sum() == 6
    at = good.index(b"\x2c")
    bomb = wide[: at + 5] + screen + screen + wide[at + 9 :]
    corner = wide[: at + 1] + (59_000).to_bytes(2, "little") * 2 + wide[at + 5 :]
    got = {r.doc_id: (r.frame, r.error) for r in gif.frames(spark.createDataFrame([(1, bomb), (2, corner), (3, good)], "doc_id bigint, gif binary")).collect()}
    assert got[1][0] is None and "60000" in got[1][1] and got[2][0] is None and "canvas" in got[2][1] and got[3] == (0, None)


def plain_lzw(stream):
    """Samples of an eight-bit code stream, read bit by bit from a table of strings; shares nothing with the decoder."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    at, width, table, last, out = 0, 9, {}, None, []
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == 256:
            table, width, last = {i: bytes([i]) for i in range(256)} | {256: b"", 257: b""}, 9, None
        elif code == 257:
            return b"".join(out)
        else:
            entry = table[code] if code in table else last + last[:1]
            if last is not None and len(table) < 4096:
                table[len(table)] = last + entry[:1]
            out.append(entry)
            last = entry
            if len(table) == 1 << width and width < 12:
                width += 1


def test_gif_features_by_another_reader(spark):
    texts = ["", "abc", "é" * 300, " ".join(f"w{i * i}" for i in range(9000)), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stored = {r.doc_id: bytes(r.gif) for r in gif.store(frame).collect()}
    for r in gif.digests(frame).collect():
        data, payload, at, frames = stored[r.doc_id], b"", 13 + 768, 0
        while data[at] != 0x3B:
            assert data[at : at + 4] == b"\x21\xf9\x04\x04" and data[at + 8] == 0x2C
            rows, at, stream = int.from_bytes(data[at + 15 : at + 17], "little"), at + 19, b""
            while data[at]:
                stream += data[at + 1 : at + 1 + data[at]]
                at += data[at] + 1
            at += 1
            part = plain_lzw(stream)
            assert len(part) == rows * 192
            payload, frames = payload + part, frames + 1
        grey = [0] * 64
        for b, n in zip(*np.unique(np.frombuffer(payload, np.uint8), return_counts=True)):
            grey[(int(b) >> 6) * 21] += int(n)
        feature = f"frames={frames};cs={frames * 10};hist=" + ",".join(f"{i}:{c}" for i, c in enumerate(grey) if c)
        assert payload.rstrip(b" ") == (texts[r.doc_id] or "").encode().rstrip(b" ")
        assert (r.feature, r.media_bytes, r.media_sha256) == (feature, len(data), hashlib.sha256(data).hexdigest())


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies on this site to make it better for you and for everybody else who comes here</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>
paragraph&nbsp;with &#233;&#x4e2d; text that is long enough to be the main text of a page.</p><aside>Related things</aside><div class="ad banner">Buy now</div>
<ul><li>Short.<li>Other</ul><form><label>Mail</label><input></form><p>a < b<br>c</p></article>
<section id="comments"><p>Great article, I like it a lot, really, and so does everyone that I know here!</p></section></main>
<div class="sidebar"><p>Side text</p></div><footer>&copy; someone</footer></body></html>"""


PAGE_TEXT = "Title & more\nFirst bold paragraph with é中 text that is long enough to be the main text of a page.\nShort.\nOther\na < b\nc"


def test_html_article():
    assert htmltext.main_text(PAGE) == PAGE_TEXT


def test_html_without_article():
    body = "".join(f"<p>Paragraph {i} is long enough to count as text of its own on this page.</p>" for i in range(4))
    page = f"<div id=menu>Home</div><div>{body}<p>End.</p></div><div class='comment-list'>Nice</div>"
    assert htmltext.main_text(page).split("\n") == [f"Paragraph {i} is long enough to count as text of its own on this page." for i in range(4)] + ["End."]
    assert htmltext.main_text("<p>tiny</p>") == "tiny"


def test_html_heads_of_articles_stay():
    page = "<div class='page-header'>Site name</div><article><div class='post-header'><h1>Title</h1></div><p class=it's>Body</p></article>"
    assert htmltext.main_text(page) == "Title\nBody"


def test_html_main_text_beside_an_article():
    body = [f"Paragraph {i} is long enough to count as text of its own on this page." for i in range(6)]
    main, ads = "<div class='content'>" + "".join(f"<p>{x}</p>" for x in body) + "</div>", "<div class=ad>" + "<p>Buy this now, it is cheaper than ever before today</p>" * 3 + "</div>"
    teaser, quote = "<article><a href='/x'>Read this too</a></article>", "<article><p>" + "A card that is long enough to surge. " * 3 + "</p></article>"
    assert htmltext.main_text(main + ads + teaser).split("\n") == body
    assert htmltext.main_text(teaser + ads + main).split("\n") == body
    for page in (teaser + main, main + teaser, main + ads + quote, quote + ads + main):
        assert [x for x in htmltext.main_text(page).split("\n") if x.startswith("Paragraph")] == body
    assert htmltext.main_text(f"<article>{main}</article>{ads}<div>Short foot</div>").split("\n") == body


def brute_stretches(sizes):
    """The kept lines by looking at every window anew."""
    window = [sum(sizes[i : i + htmltext.WINDOW]) for i in range(len(sizes))]
    runs, i = [], 0
    while i < len(sizes):
        j = i
        while j < len(sizes) and window[j] > 0:
            j += 1
        if j > i:
            runs.append((next(k for k in range(i, j) if sizes[k]), j, max(window[i:j])))
        i = j + 1
    some = [r for r in runs if r[2] >= htmltext.SURGE] or runs
    return [(a, b) for a, b, _ in some]


def test_html_surge_and_dive_against_every_window():
    rng = random.Random(12)
    for _ in range(2000):
        sizes = [rng.choice([0, 0, 0, rng.randrange(1, 40), rng.randrange(20, 200)]) for _ in range(rng.randrange(0, 30))]
        assert htmltext.stretches(sizes) == brute_stretches(sizes)


def generated_page(rng):
    """(html, main text): a text in unmarked markup, among link lists, teasers and short lines that no class gives away."""
    sentence = lambda n: " ".join(f"w{rng.randrange(10**4)}" for _ in range(n))
    links = lambda: "<div><ul>" + "".join(f"<li><a href='/{k}'>{sentence(rng.randrange(1, 5))}</a></li>" for k in range(rng.randrange(3, 9))) + "</ul></div>"
    body = [sentence(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 8))]
    for _ in range(rng.randrange(3)):
        body.insert(rng.randrange(1, len(body) + 1), sentence(1))
    inner = "".join(f"<p>{x}</p>" for x in body)
    teaser = f"<article><a href='/t'>{sentence(3)}</a></article>"
    held = rng.choice([f"<div class='{rng.choice(['content', 'no-sidebar', 'story related-work'])}'>{inner}</div>", f"<article>{inner}</article>", f"<main>{inner}</main>"])
    before = [f"<div>{sentence(2)}</div>", links(), rng.choice(["", teaser])]
    after = [links(), rng.choice(["", teaser]), f"<p>{sentence(2)}</p>"]
    return "<html><body>" + "".join(before) + held + "".join(after) + "</body></html>", "\n".join(body)


def test_html_generated_pages_are_decided_by_the_windows():
    rng = random.Random(13)
    pages = [generated_page(rng) for _ in range(300)]
    assert [htmltext.main_text(page) for page, _ in pages] == [text for _, text in pages]
    unruled = ["\n".join(text for text, _ in htmltext.lines_of(page) if text) for page, _ in pages]
    assert all(a != text for a, (_, text) in zip(unruled, pages))  # without the rule every page differs


def test_html_classes_count_whole():
    long = "A paragraph that is long enough to count as text of its own on any page at all, by itself."
    for name in ("no-sidebar", "social-science-article", "with-sidebar", "layout-sidebar-none", "header-less"):
        assert htmltext.main_text(f"<div class='{name}'><article><p>{long}</p></article></div>") == long
    assert htmltext.main_text(f"<article><p class='related-work'>{long}</p><p>End</p></article>") == f"{long}\nEnd"
    assert htmltext.main_text(f"<div class='left-sidebar'><h1>Title</h1><p>{long}</p></div>") == f"Title\n{long}"
    for attrs in ("style='overflow: hidden'", "title='a hidden gem'", "data-x='role=banner'"):
        assert htmltext.main_text(f"<div {attrs}><p>{long}</p></div>") == long
    for attrs in ("hidden", "class='main-nav x'", "id=sidebar", "role=banner", "aria-hidden='true'", "class='cookie-notice'"):
        assert htmltext.main_text(f"<div {attrs}><p>{long}</p></div><p>{long} x</p>") == f"{long} x"


def test_html_time_is_linear():
    bad = ["<a ", "<a b='>' ", '<a "', "<title>", "<!--", "<p class ", "<script> ", "</script ", "< >", "<a =", "&amp"]
    for piece in bad:
        for end in ("", ">", "\"'>"):
            page = piece * ((1_000_000 if piece == "<a " else 300_000) // len(piece)) + end
            begin = time.perf_counter()
            htmltext.main_text(page)
            assert time.perf_counter() - begin < 2, piece
    deep = "<div>" * 100_000 + "</span>" * 100_000
    begin = time.perf_counter()
    assert htmltext.main_text(deep) == "" and time.perf_counter() - begin < 4


def test_html_is_tolerant():
    for page in (None, "", "<", "<p", "</p></div>", "<script>never closed", "<article><p>a<p>b", "a &amp &bogus; b", "<!-- open"):
        assert isinstance(htmltext.main_text(page), str)
    assert htmltext.main_text("<article><p><b>one<br><p>two</p><p>three</article>") == "one\ntwo\nthree"


def test_html_columns(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<p>" + "long " * 50_000 + "</p>", "z")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [(0, "v", ""), (1, "u", PAGE_TEXT), (1, "u", PAGE_TEXT), (2, "", ""), (3, "w", ("long " * 50_000).strip())]
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_histogram_counts_visible_pixels():
    canvas = np.zeros((2, 2, 4), np.uint8)
    canvas[0, 0] = (255, 0, 64, 255)
    assert gif.histogram(canvas).sum() == 1 and gif.histogram(canvas)[3 * 16 + 1] == 1
