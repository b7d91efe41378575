import random

import numpy as np
import pytest

from fieldloom.llm import html_blocks as h

from pages import PAGES, split


@pytest.fixture(scope="module")
def net():
    return h.trained()


def test_blocks():
    got = h.blocks("<!DOCTYPE html><head><title>no</title><style>p{}</style></head><body class='a b'><!-- x<p> --><p>One &amp; <b>two</b>\n&nbsp;three<br>four<p>five<script>var t='</p>';</script></p><ul><li>x<li>y</ul>tail<div>open")
    assert [b.text for b in got] == ["One & two three four", "five", "x", "y", "tail", "open"]
    assert got[0].path == (("body", "a", "b"), ("p",)) and got[3].path[-2:] == (("ul",), ("li",))
    assert h.blocks("") == [] and h.blocks("<p> \n</p>") == [] and h.blocks("plain < text")[0].text == "plain < text"


def test_references_are_decoded_by_themselves():
    assert [b.text for b in h.blocks("<p>&am<b>p;</b> &lt;b&gt; x&#8201;y &eacute;&nbsp;<i>z</i></p>")] == ["&amp; <b> x y é z"]


def test_whole_paths_count():
    """What stands high above a block, and marks of any number, tell it from another."""
    far = lambda top: h.blocks(f"<{top}>" + "<div class='a b c d e f g h i j k'>" * 30 + "<p>Words.</p>")
    x, y = h.features([far("article"), far("section id='comments' class='discussion replies'")])
    assert (x != y)[:, : h.PATH_DIM].sum() >= 3
    one, two = h.features([h.blocks(f"<div class='{' '.join(f'm{c}' for c in 'abcdefghijklmnop')} {w}'>Words.</div>") for w in ("comment", "story")])
    assert (one != two).any()


def test_formulas_and_captions_are_blocks():
    assert [b.text for b in h.blocks("<article><p>a</p><math><mi>v</mi><mo>=</mo></math><figure><figcaption>c</figcaption></figure><svg><text>d</text></svg></article>")] == ["a", "v", "=", "c", "d"]


def test_features_of_many_pages_are_those_of_each():
    rng = random.Random(4)
    pages = [h.blocks(h.training_page(rng)[0]) for _ in range(20)] + [[]]
    for p, x in zip(pages, h.features(pages)):
        assert np.array_equal(h.features([p])[0], x) and len(x) == len(p)


def test_pages_written_by_hand(net):
    """Recall and precision of blocks over pages that the generator did not write."""
    right = wrong = missed = 0
    for marked in PAGES.values():
        page, labels = split(marked)
        p, y = h.label([h.blocks(page)], net)[0] > 0.5, np.array(labels)
        right, wrong, missed = right + int((p & y).sum()), wrong + int((p & ~y).sum()), missed + int((~p & y).sum())
    assert len(PAGES) >= 30 and right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.9


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    net = h.BiLstm(4, 3, 2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.standard_normal((2, 5, 4)), rng.integers(0, 2, (2, 5)).astype(float)
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], float)

    def loss():
        p = h._sigmoid(net(x, mask))
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = net.gradient(x, mask, y)
    for k, w in net.w.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)]:
            old = w[at]
            w[at] = old + 1e-3
            up = loss()
            w[at] = old - 1e-3
            down = loss()
            w[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_held_out_pages(net):
    rng = random.Random(12345)
    right = total = 0
    while total < 3000:
        page, labels = h.training_page(rng)
        got = h.blocks(page)
        if len(got) == len(labels):
            p = h.label([got], net)[0] > 0.5
            right, total = right + int((p == np.array(labels)).sum()), total + len(labels)
    assert right / total > 0.98


def test_pages(spark, net):
    main = "<h1>Title of it</h1><p>First   long paragraph of the story, with words &eacute;.</p><p>Second one here.</p>"
    page = f'<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><div class="ad">Buy now</div><article>{main}</article><footer>&copy; all rights reserved</footer></body></html>'
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", page, "x"), (1, "u", page, "x"), (5, "u", "<article>" + "<p>Words of a page.</p>" * 20_000 + "</article>", "x")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), net=net).collect()
    want = "Title of it\n\nFirst long paragraph of the story, with words é.\n\nSecond one here."
    assert [(r.page_id, r.text) for r in got if r.page_id == 1] == [(1, want)] * 2
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got}[2] == "" and {r.page_id: r.text for r in got}[3] == ""
    assert len({r.page_id: r.text for r in got}[5].split("\n\n")) == 20_000
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string"), net=net).collect() == []
