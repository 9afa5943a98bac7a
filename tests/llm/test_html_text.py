import time

import numpy as np
import pytest

from stratafold.llm import html_text as H


def texts(page):
    return [b.text for b in H.blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b<br>c <b>d</b>e</p>", ["a", "b c de"]),
        ("<script>var t='</p><p>no</p>';</script>x<style>p{}</style> y", ["x y"]),
        ("<!-- a <p>no</p> --><div>1 < 2 &lt; 3\n\t 4&nbsp;5</div>", ["1 < 2 < 3 4 5"]),
        ("<ul><li>a<li>b</ul>c</div>d</p>e", ["a", "b", "cd", "e"]),
        ("<title>no</title><h1>T</h1><script>open", ["T"]),
        ('<div title="a > b">x</div', ["x"]),
        ("<p>" + "w " * 100_000, [("w " * 100_000).strip()]),
        ('<div data-y="50%"><p data-y=x>hello</p></div>', ["hello"]),
        ('<p title="5" tall">one</p><p class="a" id=\'b c=">two</p>', ["one", "two"]),
        ("<p title='5>one</p>x", ["one", "x"]),
        ("a </> b <? c > d <!x> 1<2 </ p>e", ["a b d 1<2 e"]),
        ("<p/>x<br/>y<script/>z</div", ["x yz"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_gradients_agree_with_differences():
    r = np.random.default_rng(0)
    model = H.Labeller()
    pages = [r.normal(size=(t, H.SIZE)) for t in (3, 5)]
    labels = [np.array([1.0, 0, 1]), np.array([0.0, 1, 0, 0, 1])]
    x, mask, y = H.padded(pages, labels)

    def loss():
        z = model.logits(x, mask)
        p = H.sigmoid(z)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    forward, held = model._run(x, mask, "f", True)
    grad = (H.sigmoid(model.logits(x, mask)) - y) * mask / mask.sum()
    g = {}
    model._back(x, held, forward, grad, "f", g)
    for name in ("xf", "hf", "cf", "of"):
        index = tuple(n // 2 for n in model.p[name].shape)
        old = model.p[name][index]
        up, down = (model.p[name].__setitem__(index, old + e) or loss() for e in (1e-5, -1e-5))
        model.p[name][index] = old
        assert abs((up - down) / 2e-5 - g[name][index]) < 1e-6


@pytest.mark.parametrize("unit", ["<div>x", "<b>x", "<a b=\"", "<a b='", "<p class=", "</div>x", "<!-- ", "<script>", "<", "<a "])
def test_ten_megabytes_of_open_tags(unit):
    page = unit * (10_000_000 // len(unit))
    started = time.monotonic()
    found = H.blocks(page)
    assert time.monotonic() - started < 60
    if unit == "<div>x":
        assert len(found) == len(page) // 6 and all(len(b.path) <= H.PATH_DEPTH for b in found[::1000])


def test_steps_hand_on_the_states(monkeypatch):
    model = H.Labeller()
    page = H.blocks("".join(f"<div class=c{i % 7}><p>word {i} and more</p></div>" for i in range(90)))
    whole = model.score([page, page[:70]])
    monkeypatch.setattr(H, "BATCH_BLOCKS", 26)
    assert np.allclose(model.score([page, page[:70]])[0], whole[0]) and np.allclose(model.score([page[:70]])[0], whole[1, :70])


def test_classes_on_names_in_no_list():
    """Layouts of another seed, without one telling name: each class is told by its context."""
    r = np.random.default_rng(2)
    say = lambda: " ".join(f"w{r.integers(500)}" for _ in range(r.integers(6, 20))) + "."
    made = [H.labelled(*g) for g in H.generated([say() for _ in range(800)], H.GENERATED)]
    model = H.Labeller()
    model.fit([H.page_vectors(b) for b, _ in made], [y for _, y in made])
    for named, least in ((1.0, 0.97), (0.0, 0.9)):
        held = [H.labelled(*g) for g in H.generated([say() for _ in range(800)], 150, seed=99, named=named)]
        kept = np.concatenate(model.keep([b for b, _ in held]))
        y = np.concatenate([y for _, y in held])
        assert (kept[y == 1]).mean() > least and (~kept[y == 0]).mean() > least, (named, kept[y == 1].mean(), (~kept[y == 0]).mean())


def test_whole_table(spark, monkeypatch):
    """No real page is labelled in training, so all of them are held out."""
    monkeypatch.setattr(H, "EPOCHS", 8)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = H.train(pages, 100)
    source = {r.page_id: r.html for r in pages.collect()}
    out = {r.page_id: r for r in H.extract(pages, model).collect()}
    assert set(out) == set(source)
    right = 0
    for k, r in out.items():
        want = "\n".join(b.text for b in H.blocks(source[k]) if "article" in b.path)
        right += r.text == want
        assert r.n_chars == len(r.text)
    assert right >= 0.97 * len(out)
    odd = spark.createDataFrame([(1, "u", None, "x"), (1, None, "", "x"), (None, "u", "<nav>", None)], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in H.extract(odd, model).collect()] == [("", 0)] * 3
    monkeypatch.setattr(H, "GENERATED", 20)
    assert H.extract(odd.limit(0), H.train(odd.limit(0))).collect() == []
