"""Main text: parsing, inference against brute force, given and held-out layouts, odd pages."""

import itertools
import random

import numpy as np
import pytest

from tallyveil.llm import htmltext

GIVEN = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
    "<!-- ad --><div class=\"ad\">Buy &amp; go.</div><article><h1>%s</h1><p><b>First of it.<br><p>Second &lt;b&gt; of\n it. </p></article><footer>&copy; end</footer>"
)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    pages = [GIVEN % " ".join(htmltext.made_up_prose(rng, 1))[:60] for _ in range(100)]
    return htmltext.fit(htmltext.training_pages(pages))


def read(page, field):
    return htmltext.main_text(page, field, field.weights.tolist())


def test_blocks_of_broken_markup():
    def texts(page):
        return [b.text for b in htmltext.blocks_of(page)]

    assert texts("a<p>b<p>c<b>d<br>e</b></i>&eacute;&#33;<div>f<li>g</ul>h") == ["a", "b", "cd eé!", "f", "g", "h"]
    assert texts("<script>if (a < b) '</p>'</script>x<!-- y --><style>z") == ["x"]
    assert texts("<head><title>t</title><p>shown") == ["shown"]
    assert texts("<select><option>a</select>b <a href='>'>c</a> < d <") == ["b c < d <"]
    assert texts("<p title=don't>a</p><p class=\"x>b") == ["a", "b"]
    assert texts("") == texts("<div></div> \n") == []
    marks = htmltext.blocks_of('<div class="siteNav top-bar"><ul id=menu><li>x</ul></div><p>y')
    assert {"div", ".site", ".nav", ".top", ".bar", ".menu", "li"} <= marks[0].marks and marks[1].marks == {"p"}


def test_deep_and_long_pages(field):
    deep = "".join(f'<div class="c{i}x{i % 7}">' for i in range(20_000)) + "x"
    assert [b.text for b in htmltext.blocks_of(deep)] == ["x"]
    body = "It is a long story. " * 20_000
    assert read(GIVEN.replace("First of it.", body) % "T", field).startswith("T It is a long story. It")
    assert len(read(GIVEN.replace("First of it.", body) % "T", field)) > 390_000
    assert htmltext.blocks_of("<a \"" * 20_000 + "'" * 2001) == []


def test_inference_equals_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        emission, moves, start = rng.normal(size=n), rng.normal(size=(2, 2)), float(rng.normal())
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([start * p[0] + sum(e * s for e, s in zip(emission, p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        share = np.exp(weight - weight.max())
        share /= share.sum()
        p, expected = htmltext.marginals(emission, moves, start)
        assert np.allclose(p, [sum(w for w, q in zip(share, paths) if q[i]) for i in range(n)])
        counts = np.zeros((2, 2))
        for w, q in zip(share, paths):
            for a, b in zip(q, q[1:]):
                counts[a, b] += w
        assert np.allclose(expected, counts)
        assert htmltext.viterbi(emission.tolist(), moves.tolist(), start) == [bool(s) for s in paths[int(weight.argmax())]]


def test_given_layout(field):
    assert read(GIVEN % "Of a title", field) == "Of a title First of it. Second <b> of it."


def test_dressed_pages_held_out(field):
    rng = random.Random(99)
    wrong = total = 0
    weights = field.weights.tolist()
    for _ in range(200):
        blocks, labels = htmltext.labelled_blocks(htmltext.dressed(htmltext.made_up_prose(rng, rng.randint(2, 12)), htmltext.made_up_prose(rng, 5), rng))
        emission = [sum(weights[i] for i in ids) for ids in htmltext.features(blocks)]
        states = htmltext.viterbi(emission, field.moves.tolist(), field.start)
        wrong += sum(a != b for a, b in zip(states, labels))
        total += len(labels)
    assert wrong <= 0.03 * total


def test_layout_of_no_template(field):
    page = (
        '<body><div class="page-head"><h1>Site</h1></div><nav><a href=x>Home</a> <a href=y>News</a></nav><div class="cookie-bar">We use cookies</div>'
        '<div class="article-text"><h1>Title of it</h1><p>Some long text here. It goes on and on, for a while.</p><div class="advert-box">Buy now</div>'
        '<p>More text of it. It ends here.</p></div><div id="comment-area"><h2>Comments</h2><p>I like it very much. Thanks.</p></div>'
        '<form><label>Email</label><button>Go</button></form><div id="pageFooter">&copy; 2024 x</div></body>'
    )
    assert read(page, field) == "Title of it Some long text here. It goes on and on, for a while. More text of it. It ends here."


def test_table_of_odd_rows(spark):
    pages = [(i, f"u{i}", GIVEN % f"Title {i}", "clash") for i in range(30)] + [(None, None, None, None), (5, "u5", "", ""), (5, "u5", GIVEN % "Title 5", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, main_text string")
    field = htmltext.train(table)
    rows = htmltext.extract(table, field).select("page_id", "main_text").collect()
    assert len(rows) == 33 and sorted(r["main_text"] for r in rows)[:2] == ["", ""]
    assert sum(r["main_text"] == "Title 5 First of it. Second <b> of it." for r in rows) == 2
    empty = table.limit(0)
    assert htmltext.extract(empty, htmltext.train(empty)).count() == 0
    again = htmltext.train(table)
    assert np.array_equal(again.weights, field.weights)
