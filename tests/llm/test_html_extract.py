import itertools
import time

import numpy as np
import pytest

from shelfmark.llm import html_extract as h


def texts(page):
    return [b.text for b in h.read_blocks(page)]


def test_blocks_of_untidy_markup():
    page = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script><style>p{}</style></head>
    <body><!-- no <p>no</p> --><p>One <b>two</b>&nbsp;&amp;
    three<br>four<p>Five<ul><li>six<li>se<i>ven</i></ul><table><tr><td>a<td>b</table>
    <SCRIPT>no</Script ><div title="a > b">x < y &lt;b&gt; &#233;</div>tail"""
    assert texts(page) == ["One two & three four", "Five", "six", "seven", "a", "b", "x < y <b> é", "tail"]


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<script>never closed", "<!-- never closed <p>x</p>", "<", "<a href='x", "<div title=\"never closed>"])
def test_odd_pages_do_not_fail(page):
    h.extract(h.Model(), page)


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p><p>next</p>", ["so x=2 holds", "next"]),
        ("<p>an <svg viewBox='0 0 1 1'><text>icon</text><path d='M0'/></svg> here</p>", ["an here"]),
        ("<p>an <svg><path d='M0'> here<p>kept</p><p>and <svg><g/></svg>this</p>", ["an", "kept", "and this"]),
        ("<p>a <svg><foreignObject><div>label</div></foreignObject></svg> b</p>", ["a b"]),
        ("<p>a <noscript><p>turn it on</p></noscript> b</p><p>c</p>", ["a b", "c"]),
        ("<p>a <canvas>none<p>c</p>", ["a", "c"]),
        ("<p>a</p><svg>", ["a"]),
        ("<p>a</p><script>var x = '<p>no</p>'", ["a"]),
    ],
)
def test_formulas_and_drawings(page, blocks):
    assert [b.text for b in h.read_blocks(page)] == blocks


def test_many_elements_without_end_take_linear_time():
    began = time.perf_counter()
    assert len(h.read_blocks("<svg><p>word " * 20_000)) == 20_000
    assert h.read_blocks("<svg> <object> " * 40_000) == []
    assert time.perf_counter() - began < 5


def test_paths_links_and_implied_ends():
    blocks = h.read_blocks("<nav class='top Menu'><ul><li><a href=x>Home</a><li>Two <a>three</a></ul></nav><article><p>x<p>y<div>z</div></article>")
    assert [b.path for b in blocks[:2]] == [("nav top menu", "ul", "li")] * 2
    assert [round(b.links, 2) for b in blocks[:2]] == [1.0, 0.56]
    assert [b.path[-1] for b in blocks[2:]] == ["p", "p", "div"]
    assert all(b.path[0] == "article" for b in blocks[2:])


def test_viterbi_and_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(5)
    for n in (1, 2, 6):
        e, t = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        every = list(itertools.product((0, 1), repeat=n))
        total = np.array([sum(e[k, y[k]] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)) for y in every])
        assert h.viterbi(e, t) == list(every[total.argmax()])
        p = np.exp(total) / np.exp(total).sum()
        single, pairs = h._marginals(e, t)
        assert np.allclose(single[:, 1], [sum(w for w, y in zip(p, every) if y[k]) for k in range(n)])
        want = np.zeros((2, 2))
        for w, y in zip(p, every):
            for a, b in zip(y, y[1:]):
                want[a, b] += w
        assert np.allclose(pairs, want)


@pytest.fixture(scope="module")
def model(given):
    pages = [page for (page,) in given("sf0.01", "pages", "html")]
    some = [b.text for page in pages[:60] for b in h.read_blocks(page)]
    settings = h.Settings(pages=250, epochs=5)
    return h.fit(h.labelled_pages(some, settings), settings), pages


def test_pages_of_other_seeds_are_labelled_rightly(model):
    known, pages = model
    apart = h.labelled_pages([b.text for page in pages[100:160] for b in h.read_blocks(page)], h.Settings(pages=120, seed=77))
    right = [label == b.label for blocks in apart for label, b in zip(h.viterbi(known.emissions(blocks), known.transitions), blocks)]
    assert np.mean(right) > 0.98


def test_given_pages_give_their_articles(model):
    known, pages = model
    right = 0
    for page in pages:
        article = "\n\n".join(b.text for b in h.read_blocks(page) if any(e.split(" ")[0] == "article" for e in b.path))
        right += h.extract(known, page) == article
    assert right >= 0.98 * len(pages)


def test_surroundings_go(model):
    page = """<body><div id="header"><a href=/>Site</a></div><ul class="menu"><li><a href=/a>News</a></ul><div class="cookie-banner">We use cookies.</div>
    <main><h1>A storm over the coast</h1><p>The wind rose at noon, and by three the harbour was closed.</p><ul><li>First boats, then cars.</li></ul>
    <div class="comments"><p>Great piece, thank you all for this one.</p></div></main>
    <aside class="sidebar"><p>Subscribe to our newsletter today.</p></aside><form><label>Name</label></form><footer>&copy; 2024 Site</footer>"""
    assert h.extract(model[0], page).split("\n\n") == ["A storm over the coast", "The wind rose at noon, and by three the harbour was closed.", "First boats, then cars."]


def test_over_pages(spark):
    long = "<article>" + "<p>Some words stand here, and more.</p>" * 20_000 + "</article>"
    schema = "page_id long, url string, html string, text string, n_chars int, _x string"
    rows = [(1, "u", "<article><p>One two three four, five.</p></article>"), (1, "u", "<article><p>One two three four, five.</p></article>"), (2, None, None), (3, "v", ""), (None, "w", "<script>x</script>"), (4, "z", long)]
    pages = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], schema)
    got = h.extract_pages(pages, h.Settings(pages=150, epochs=4))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    assert by[1].text == "One two three four, five." and by[1].n_chars == 25
    assert by[2].text == by[3].text == by[None].text == ""
    assert by[4].text.count("\n\n") == 19_999
    assert h.extract_pages(pages.limit(0), h.Settings(pages=20, epochs=1)).count() == 0
