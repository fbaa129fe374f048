import hashlib
import random
import string
from html.parser import HTMLParser

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforest.llm import html_text, line_dedup, warc
from spanforest.llm.common import get


def page(rng, n):
    return "<html>" + " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(n)) + "</html>"


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(2)
    shared = [page(rng, 40) for _ in range(5)] + ["short", "é" * 49, "é" * 50]
    rows = [(i, f"http://x.example/{i}?q=a b\n", rng.choice(shared) if rng.random() < 0.5 else page(rng, rng.choice([1, 30, 3000]))) for i in range(-3, 120)]
    rows += [(500, None, None), (501, "http://é.example/", ""), (502, "u", "WARC/1.1\r\n\r\nodd \x00 payload" * 9), (None, "no id", shared[0]), (None, "no id", page(rng, 50)), (7, rows[10][1], rows[10][2]), (700, "", page(rng, 200000))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    manifest = warc.write_archives(pages, folder=(tmp_path / "w").as_uri(), file_bytes=40000)
    got = warc.read_archives(manifest).collect()
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h in first and i != first[h]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response")
    files = manifest.collect()
    assert len(files) > 4 and sum(f.n_records for f in files) == len(rows)
    data = get(files[0].file)
    assert data[:4] == bytes.fromhex("5D2A4D18") and len(data) == files[0].n_bytes
    # Only exactly repeated rows share a record id, and every revisit refers to a response's id.
    heads = [warc.parse(r)[0] for f in files for r in warc.frames(get(f.file))]
    names = [h["warc-record-id"] for h in heads]
    assert len(set(names)) == len(set(map(repr, rows))) + len(files) and len(names) == len(rows) + len(files)
    responses = {h["warc-record-id"]: h["warc-payload-digest"] for h in heads if h["warc-type"] == "response"}
    assert all(responses[h["warc-refers-to"]] == h["warc-payload-digest"] for h in heads if h["warc-type"] == "revisit")
    few = warc.write_archives(pages.filter("page_id between 0 and 6").coalesce(1)).collect()
    assert len(few) == 1 and get(few[0].file)[:4] == bytes.fromhex("5D2A4D18")
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_records_are_frames_of_their_own_and_damage_shows():
    rng = random.Random(3)
    records = [warc.record(i, f"u{i}", page(rng, 50).encode(), "0" * 64, None, False) for i in range(50)]
    dictionary = warc.train(records)
    few = warc.train(records[:7])
    assert dictionary and warc.train([]) == b"" == warc.train([b"x"]) and few == b"".join(records[:7])[: warc.DICTIONARY_BYTES] and warc.train([b"alike" * 50] * 9)
    for known in (dictionary, few, b""):
        writer = warc.Writer(known)
        for r in records:
            writer.add(r)
        data = b"".join(writer.pieces)
        assert list(warc.frames(data))[1:] == records
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(data[:-5]))
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(data[:-5] + b"12345"))
    with pytest.raises(ValueError):
        warc.parse(records[0][:-1])


TREE = html_text.grow(*html_text.labelled())
ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this</div>
<article><header><h1>Head&eacute; &amp; line</h1></header><p>One  two
three.<p>Short<br>line<p><b>Bold</b>ly <a href=x>linked</a> words &lt;p&gt; stay&nbsp;here</p><aside>no</aside><form><label>Name</label><input></form><div hidden>no</div><div style="display: none">no</div><ul><li>first<li>second</ul></article>
<section id="comments"><article class="comment"><p>A reader says a lot of words about all this</p></article></section><div class="cookie-notice"><p>We use cookies and you should agree to that now</p></div><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert html_text.main_texts([ARTICLE], TREE)[0].split("\n") == ["Headé & line", "One two three.", "Short line", "Boldly linked words <p> stay here", "first", "second"]


@pytest.mark.parametrize("page, text", [
    ('<article><p class="share-price">The price went up by far.</p></article>', "The price went up by far."),
    ('<article><div class="tags-explained">What tags are for</div></article>', "What tags are for"),
    ('<article><h2 id="comment-on-law">Comment on law</h2><p>Some words of text here.</p></article>', "Comment on law\nSome words of text here."),
    ('<article><p>One paragraph of words.</p><p><a href="x">A paragraph that is a link as a whole</a></p><p>Another paragraph of words here.</p></article>', "One paragraph of words.\nA paragraph that is a link as a whole\nAnother paragraph of words here."),
    ("<article><p>As <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", "As x=1 holds."),
    ('<html class="js widget"><body class="page has-sidebar"><div class="widget"><main><p>Words of the main text in a wrapper.</p><p class="share-buttons">Share this now</p><ul class="relatedPosts"><li>Other text</li></ul></main></div></body></html>', "Words of the main text in a wrapper."),
    ('<div class="elementor-widget"><article><p>Words of an article in a wrapper.</p><div class="cookie-notice-box">We use cookies here</div><div id="comments-area"><p>A reader says so</p></div></article></div>', "Words of an article in a wrapper."),
])
def test_names_are_whole(page, text):
    assert html_text.main_texts([page], TREE) == [text]


class Outline(HTMLParser):
    """An independent reading of well-formed pages: paragraphs and headings of the article, in order, by a parser's tree."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.out, self.now = [], [], None
        self.feed(page)
        self.close()
        self._end()

    def _end(self):
        if self.now is not None and (text := " ".join("".join(self.now).split())):
            self.out.append(text)
        self.now = None

    def handle_starttag(self, tag, attributes):
        if tag in ("br", "meta", "link", "img", "hr", "input"):
            if tag == "br" and self.now is not None:
                self.now.append(" ")
            return
        if tag in ("p", "li") and self.path and self.path[-1][0] == tag:
            self.path.pop()
        inside = bool(self.path) and self.path[-1][1] or tag == "article"
        out = bool(self.path) and self.path[-1][2] or tag in ("nav", "aside", "footer", "form", "script", "style") or dict(attributes).get("class") == "ad"
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self._end()
        self.path.append((tag, inside, out))

    def handle_endtag(self, tag):
        while any(t == tag for t, *_ in self.path):
            gone = self.path.pop()[0]
            if gone not in ("a", "b", "i", "em", "strong", "span"):
                self._end()
            if gone == tag:
                break

    def handle_data(self, data):
        if self.path and self.path[-1][1] and not self.path[-1][2]:
            self.now = [*(self.now or []), data]


def test_whole_table_equals_a_parser_tree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    rows = pages.collect()
    marked = [r for r in rows if r.html and "<article" in r.html]
    assert len(got) == len(rows) and len(marked) > len(rows) // 2
    wrong = [r.page_id for r in marked if got[r.page_id] != "\n".join(Outline(r.html).out)]
    assert not wrong, f"{len(wrong)} of {len(marked)}: {wrong[:3]}"


def test_page_without_article_element():
    text = html_text.main_texts([
        """<body><div id="header"><a href=/>Site</a></div><div class="menu"><a>a</a> <a>b</a></div><div><h1>A headline of the page</h1><p>First paragraph with enough words to be text, and it goes on for a while until the end of it.</p><p>Second paragraph which also has
        enough words to be a text that one would like to read with pleasure.</p></div><div><a>Related one</a> <a>Related two</a></div><div class="sidebar"><p>Side bar text with several words in it, not part of the text at all</p></div><div class="footer">All rights reserved</div>"""
    ], TREE)[0].split("\n")
    assert text[0] == "A headline of the page" and text[1].startswith("First") and text[2] == "Second paragraph which also has enough words to be a text that one would like to read with pleasure." and len(text) == 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<script>", "</script>", "<a href=x>", "</a>", "<!--", "-->", "<", ">", "&amp;", "&", "\"", "'", " text ", "<br/>", "<b", "</", "<![CDATA[", "]]>", "<body>", "<li>"]), max_size=40))
def test_any_markup_is_read_to_the_end(pieces):
    for block in html_text.blocks_of("".join(pieces)):
        assert block.text == " ".join(block.text.split()) and block.words == len(block.text.split())


def test_extraction_of_a_table(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p>" + "many words in a long text " * 20000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int").repartition(3)
    got = html_text.extract(df).collect()
    assert sorted(repr(r.page_id) for r in got) == sorted(repr(r[0]) for r in rows)
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.n_chars for r in got}[None] == 20000 * 26 - 1
    assert all(r.text == "" for r in got if r.page_id in (2, 3))
    assert html_text.extract(df.limit(0)).count() == 0


def brute_chunks(text):
    """Chunks by the operator's own rule, line by line."""
    import numpy as np
    import pyarrow as pa

    from spanforest.llm.common import binary

    offsets, data = binary(pa.array([text]))
    begin, end, first = line_dedup.lines_of(offsets, data)
    assert [data[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)] == text.split("\n")
    start, stop = line_dedup.chunks_of(line_dedup.hashes_of(data, begin, end), first)
    assert start.tolist() == [0, *stop[:-1].tolist()] and stop[-1] == len(begin)
    sizes = np.diff([0, *stop.tolist()])
    assert all(sizes <= line_dedup.MOST_LINES) and all(s >= line_dedup.LEAST_LINES for s in sizes[:-1] if s != line_dedup.MOST_LINES)
    return list(zip(start.tolist(), stop.tolist(), strict=True))


def brute_removal(rows):
    seen, out = {}, {}
    for i, text in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        if i in out:
            continue
        lines, kept, n, gone = text.split("\n"), [], 0, 0
        for a, b in brute_chunks(text):
            own = tuple(lines[a:b])
            if b - a >= 2 and any(ord(c) > 32 for x in own for c in x) and own in seen:
                n, gone = n + 1, gone + b - a
            else:
                seen.setdefault(own, i)
                kept += own
        out[i] = ("\n".join(kept), len(lines), n, gone)
    return out


def test_repeated_chunks_go(spark):
    rng = random.Random(12)
    say = lambda: " ".join(rng.choice(string.ascii_letters) * rng.randint(1, 5) for _ in range(8))
    passages = [[say() for _ in range(rng.choice([6, 12, 40]))] for _ in range(6)]
    rows = []
    for i in range(150):
        lines = [say() for _ in range(rng.randint(0, 9))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(passages)
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n" * 500), (903, "\n" * 500), (904, "one line"), (905, "one line"), (906, "a\r\n" * 3000), (None, "\n".join(passages[0])), (40, rows[40][1]), (907, "same\nsame\n" * 200)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, size int").repartition(5)
    got = line_dedup.drop_repeated(docs).collect()
    assert len(got) == len(rows)
    want = brute_removal(rows)
    for r in got:
        if r.doc_id in want:
            assert (r.text, r.n_lines, r.n_chunks_removed, r.n_lines_removed) == want[r.doc_id], r.doc_id
    by = {r.doc_id: r for r in got}
    assert by[900].text is None and by[None].text == "\n".join(passages[0]) and by[904].text == by[905].text == "one line"
    assert sum(r.n_chunks_removed for r in got) > 100
    assert line_dedup.drop_repeated(docs.limit(0)).count() == 0


def test_borders_find_themselves_again_after_a_shift():
    rng = random.Random(5)
    lines = [f"line {rng.random()}" for _ in range(400)]
    a = {tuple(lines[x:y]) for x, y in brute_chunks("\n".join(lines))}
    shifted = ["new"] * 3 + lines[:200] + ["inserted"] + lines[200:]
    b = {tuple(shifted[x:y]) for x, y in brute_chunks("\n".join(shifted))}
    assert len(a & b) > 0.9 * len(a)


def brute_repeats(rows):
    """Every run of lines that stands at an earlier place, lengthened line by line as far as both places agree."""
    texts = sorted((i, t.split("\n")) for i, t in rows if i is not None and t is not None)
    places, out = {}, {}
    for i, lines in texts:
        for k, line in enumerate(lines):
            places.setdefault(line, []).append((i, k))
    docs = dict(texts)
    for i, lines in texts:
        gone = set()
        for k, line in enumerate(lines):
            for j, m in places[line]:
                if (j, m) >= (i, k):
                    break
                other, n = docs[j], 0
                while k + n < len(lines) and m + n < len(other) and lines[k + n] == other[m + n]:
                    n += 1
                # White space alone is no repeat; at its ends one such line goes along.
                told = [x for x in range(k, k + n) if lines[x].strip()]
                a, b = (max(k, told[0] - 1), min(k + n, told[-1] + 2)) if told else (k, k)
                if b - a >= 2 or b - a == 1 and len(lines[a].split()) > 50:
                    gone |= set(range(a, b))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len([k for k in gone if k - 1 not in gone]), len(gone))
    return out


def test_repeats_of_few_lines_go_whatever_stands_around_them(spark):
    rng = random.Random(31)
    say = lambda n: " ".join("".join(rng.choice(string.ascii_letters) for _ in range(5)) for _ in range(n))
    rows, passages = [], {}
    for n in range(1, 9):
        for k in range(12):
            passages[n, k] = [say(60 // n + 1) for _ in range(n)]
            for copy in range(2):
                lines = [say(8) for _ in range(rng.randint(0, 7))]
                at = rng.randint(0, len(lines))
                rows.append((1000 * copy + 20 * n + k, "\n".join(lines[:at] + passages[n, k] + lines[at:])))
    for i in range(2000, 2150):  # few different lines: repeats that overlap, and white space
        rows.append((i, "\n".join(rng.choice(["", "", " ", "a", "b", "c\r", say(3), say(55)] if i % 2 else ["", "a"]) for _ in range(rng.randint(1, 12)))))
    rows += [(3000, None), (3001, ""), (3002, "\n" * 500), (3003, "\n" * 500), (3004, "one line"), (3005, "one line"), (3006, "a\r\n" * 300), (None, rows[0][1]), (40, dict(rows)[40]), (3007, "same\nsame\n" * 20)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, size int").repartition(5)
    got = line_dedup.drop_repeats(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for (n, k), lines in passages.items():
        assert "\n".join(lines) in by[20 * n + k].text and not any(x in by[1000 + 20 * n + k].text for x in lines), (n, k)
    want = brute_repeats(set(rows))
    for r in got:
        if r.doc_id in want:
            assert (r.text, r.n_lines, r.n_chunks_removed, r.n_lines_removed) == want[r.doc_id], r.doc_id
    assert by[3000].text is None and by[None].text == rows[0][1] and by[3004].text == by[3005].text == "one line"
    assert line_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_a_very_long_page_leaves_the_archive_its_dictionary(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"u{i}", page(rng, 60)) for i in range(60)]
    docs = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    order = docs(rows).selectExpr("page_id", "xxhash64(page_id, url) as h").orderBy("h").collect()
    first = order[0].page_id  # the page that a sample begins with
    rows[first] = (first, f"u{first}", "<p>" + "é" * 5_000_000)
    pages = docs(rows).repartition(2)
    sample = warc._sampled(pages, "page_id", "url", "html")
    assert len(sample) == 60 and sum(map(len, sample)) < warc.SAMPLE_BYTES
    for f in warc.write_archives(pages, folder=(tmp_path / "w").as_uri()).collect():
        assert get(f.file)[:4] == bytes.fromhex("5D2A4D18")
