import os
import subprocess
import sys

import numpy as np
import pytest

from rarefy.llm import html as H

from .helpers import HAVE, SF, table


def shown(page):
    return [t for _, t, _ in H.blocks(page)]


def test_blocks():
    assert shown("<p>a <b>b</b>&amp;c<p>d<br>e</p>tail") == ["a b&c", "d", "e", "tail"]
    assert shown("<p> \n x&nbsp;&lt;y&gt; \t z </p>") == ["x <y> z"]
    assert shown("<script>var t='</p>';if(a<b){}</script><style>p{}</style>5 < 6 <!-- no --> yes") == ["5 < 6 yes"]
    assert shown("<title>no</title><ul><li>a<li>b</ul><td>c<td>d") == ["a", "b", "c", "d"]
    assert shown("<div title='a > b'>x</div></p></div></b>y<") == ["x", "y<"]
    assert shown("") == [] and shown("<script>never closed <p>x") == [] and shown("plain") == ["plain"]
    assert [p.tag for p, _, _ in H.blocks("<p><b>open<p>next")] == ["b", "p"]
    assert shown("<html><head><title>t</title><meta x><h1>no end tags</h1><p>y") == ["no end tags", "y"]
    assert shown("<head><title>t</title>stray text") == ["stray text"]
    assert shown("<p>a <math><mi>x</mi></math> <object>o</object></p><noscript>n</noscript>") == ["a", "x", "o", "n"]
    assert shown("<svg><path d='x'/><text>label</text></svg><select><option>no</select><textarea>no</textarea>z") == ["label", "z"]
    assert len(shown("<div>" * 5000 + "deep")) == 1
    assert len(shown("<div>x<b>y" * 20_000 + "</i></p></td>" * 20_000)) == 20_000


def test_places(monkeypatch):
    """The whole path counts, at any depth; kept places change nothing."""
    deep = H.blocks("<nav class=menu>" + "<div>" * 300 + "x")[0][0]
    other = H.blocks("<div>" * 301 + "x")[0][0]
    assert deep.depth == 301 and (deep.vector() != other.vector()).any()
    page = "".join(f"<div class=c{i % 50}><p>x{i}" for i in range(400))
    first = H.vectors(H.blocks(page))
    monkeypatch.setattr(H, "PLACES", 10)
    assert np.allclose(H.vectors(H.blocks(page)), first, atol=1e-5)
    found = H.blocks(page)
    assert np.allclose(np.r_[H.vectors(found, 0, 150), H.vectors(found, 150)], first, atol=1e-5)


LONG = """
import resource, sys
from rarefy.llm import html as H
page = "<nav><a href=/>m</a></nav><article>" + "<p>ten chars." * 400_000
found = H.blocks(page)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
label = H.Labeller().label([found])[0]
assert len(label) == 400_001
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_very_long_page_in_bounded_memory():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", LONG], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout) < 1000


def test_steps_change_nothing(rng, monkeypatch):
    model = H.Labeller()
    pages = [rng.normal(size=(n, H.INPUT)) for n in (1, 7, 30, 31)]
    whole = [model.scores(*H._padded([p]))[:, 0] for p in pages]
    monkeypatch.setattr(H, "STEP_BLOCKS", 12)
    odds = model._odds(pages)
    for k, p in enumerate(pages):
        assert np.allclose(H._sigmoid(odds[: len(p), k]), whole[k])


def test_gradients(rng):
    model = H.Labeller()
    x, mask = H._padded([rng.normal(size=(4, H.INPUT)), rng.normal(size=(2, H.INPUT))])
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        s = np.clip(model.scores(x, mask), 1e-12, 1 - 1e-12)
        return -((y * np.log(s) + (1 - y) * np.log(1 - s)) * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for name, p in model.p.items():
        at = tuple(rng.integers(n) for n in p.shape)
        kept = p[at]
        p[at] = kept + 1e-5
        up = loss()
        p[at] = kept - 1e-5
        down = loss()
        p[at] = kept
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6, name


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_unseen_layouts(model):
    right = total = 0
    for page, texts in H.training_pages(150, seed=77):
        found, y = H.labelled(page, texts)
        assert y.sum() == len(texts)
        if len(found):
            right += (model.label([H.vectors(found)])[0] == (y > 0)).sum()
            total += len(y)
    assert right / total > 0.99


def test_context_counts(model):
    page = "<nav><ul><li><a href=/a>Home</a></li></ul></nav><aside><p>An old story.</p></aside><article><h1>Title</h1><p>One.</p><p>Two.</p></article><footer>&copy; x</footer>"
    found = H.blocks(page)
    assert [t for (_, t, _), y in zip(found, model.label([H.vectors(found)])[0]) if y] == ["Title", "One.", "Two."]
    alone = model.label([H.vectors(found), H.vectors(found[:3])])
    assert (alone[0] == model.label([H.vectors(found)])[0]).all()


@pytest.mark.skipif(not HAVE, reason="no test tables here")
def test_query(spark):
    import html
    import re

    got = table(H.op4_html(spark, SF)).set_index("page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?p>|<br>|</?h1>", inside)]
        assert got.loc[r.page_id].text == "\n".join(p for p in parts if p)
        assert got.loc[r.page_id].n_chars == len(got.loc[r.page_id].text)


def test_edges(spark, model):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (4, "v", "<nav>only a menu</nav>"), (4, "v", "<nav>only a menu</nav>"), (5, "w", "<article>" + "<p>A sentence of it.</p>" * 3000 + "</article>")]
    got = table(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS h", "1 AS text"), model))
    assert len(got) == 6 and got[got.page_id.isin([1, 2])].text.tolist() == ["", ""]
    assert got[got.page_id == 5].text.iloc[0].count("\n") == 2999
    assert table(H.extract(spark.createDataFrame([], "page_id long, url string, html string"), model)).empty
