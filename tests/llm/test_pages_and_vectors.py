"""Page text and top-k search against brute force."""

import html
import random
import time

import numpy as np
import pytest

from tidelint.llm import page_content, topk_index
from tidelint.llm.labelled_pages import PAGES

LONG = " ".join(["Thread of long prose that goes on and on, with commas, for a good while."] * 6)
WANT = "\n".join(["Title & co", LONG, "Short one.", LONG])
ARTICLE = f"<h1>Title &amp; co</h1><p>{LONG}</p><p>Short\n <b>one</b>.</p><p>{LONG}</p>"


@pytest.fixture(scope="module")
def model():
    return page_content.Model(PAGES)


@pytest.mark.parametrize("page", [
    f"<body><header><h1>Site</h1><p>Tag line</p></header><nav><a href=x>Home</a></nav><main><article>{ARTICLE}</article><aside><p>{LONG}</p></aside></main><footer><p>{LONG}</p></footer></body>",
    f"<body><div class=content>{ARTICLE}</div><section class='comments'><h2>Comments</h2><article><p>{LONG}</p></article></section></body>",
    f"<body><article>{ARTICLE}<div class='comments'><p>{LONG}</p><p>nice</p></div><form><p>{LONG}</p><input></form></article></body>",
    f"<body><div class='cookie-banner'><p>{LONG}</p></div><div role=alert>Notice: {LONG}</div><article>{ARTICLE}</article><div class='sidebar'><ul><li>{LONG}</li></ul></div></body>",
    f"<body><script>if (a<b) document.write('<p>x</p>')</script><!-- <p>{LONG}</p> --><style>p{{}}</style><nav><ul><li>a<li>b</ul></nav><article>{ARTICLE}",
    f"<html><head><title>x</title></head><body><div><div><a href=a>A</a> <a href=b>B</a></div></div><div><div>{ARTICLE}</div></div><div>Copyright</div></body>",
])
def test_layouts(model, page):
    assert page_content.texts([page], model) == [WANT]


@pytest.mark.parametrize("before", [
    "<html><head><title>T</title>", "<html><head><script>document.write('<body><p>no')</script><style>p{}</style>", "<body><svg><path d=1>", "<body><div><svg><g><text>no</text></div>",
    "<body><select><option>no", "<body><button>", "<body><div><button>no</div>", "<body><iframe src=x>", "<body><noscript>", "<body><object><param>", "<body><template>", "<body><video src=x>",
])
def test_open_tags_hide_nothing_else(model, before):
    assert page_content.texts([f"{before}<article>{ARTICLE}</article>"], model) == [WANT]


@pytest.mark.parametrize("hidden", [
    "<svg><svg></svg><foreignObject><div>no</div></foreignObject></svg>", "<button><div>no</div></button>", "<select><option>no</select>", "<video><p>Your browser shows no films.</p></video>",
    f"<template><article><p>{LONG}</p></article></div></template>", f"<object><object></object><p>{LONG}</p></object>", "<iframe><p>no</p></iframe>", "<button>no</button><button>no</button>",
])
def test_closed_elements_stay_hidden(model, hidden):
    assert page_content.texts([f"<body><article>{hidden}{ARTICLE}</article>"], model) == [WANT]
    assert page_content.texts([f"<body><div>{hidden}</div><article>{ARTICLE}</article>"], model) == [WANT]


@pytest.mark.parametrize("name", ["footnote", "footage", "navy", "social", "legal", "related", "search", "response", "share price", "pagination", "notice", "plain"])
def test_words_on_a_paragraph(model, name):
    page = f"<body><nav><a href=x>Home</a></nav><article><p>{LONG}</p><p class='{name}'>{LONG}</p><p class='{name}'>Short.</p></article><div class='{name.replace('plain', 'related')}'><ul><li><a href=y>More</a></ul></div></body>"
    assert page_content.texts([page], model) == ["\n".join([LONG, LONG, "Short."])]


def test_formulas_are_text(model):
    page = f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be. {LONG}</p></article>"
    assert page_content.texts([page], model) == [f"Let x=1 be. {LONG}"]


@pytest.mark.parametrize("tag", ["div", "header", "p", "li", "svg", "button"])
def test_reading_is_linear_in_depth(tag):
    def seconds(n):
        start = time.process_time()
        page_content.Page(f"<{tag}>" * n + "x")
        return time.process_time() - start

    assert seconds(40_000) < 20 * max(seconds(4_000), 0.02)


def test_odd_pages(spark):
    deep = "<div>" * 400 + "x" + "</div>" * 400
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<"), (4, "u", "<p title='a"), (5, "u", deep), (6, "u", "<table><tr><td>a<td>b</table>"), (6, "u", f"<article>{ARTICLE}</article>"), (None, "u", "</p></div>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = page_content.main_text(df).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert WANT in {r.text for r in got} and page_content.main_text(df.limit(0)).count() == 0


def test_marginals_equal_enumeration(model):
    trees = page_content.Trees([page_content.Page("<body><nav><p>a</p></nav><article><p>" + "long text " * 40 + "</p></article></body>")])
    n = len(trees.parent)
    own = sum(table[values] for table, values in zip(model.nodes, trees.seen, strict=True))
    total = np.zeros((n, 3))
    for states in np.ndindex(*[3] * n):
        score = sum(own[i, s] for i, s in enumerate(states)) + sum(model.pairs[states[trees.parent[i]], states[i]] for i in range(1, n))
        total[np.arange(n), states] += np.exp(score)
    assert np.allclose(trees.marginals(model), total / total.sum(1, keepdims=True))


def test_held_out_labels():
    right = wrong = 0
    for i, page in enumerate(PAGES):
        own = page_content.Page(page)
        states, p = page_content._states(own), page_content.Trees([own]).marginals(page_content.Model(PAGES[:i] + PAGES[i + 1:]))
        for node, state in enumerate(states):
            if own.size[node] and state != page_content.STRUCTURE:
                good = (p[node, 1] > p[node, 0]) == (state == page_content.CONTENT)
                right, wrong = right + good, wrong + (not good)
    assert right / (right + wrong) > 0.9


def test_made_pages_come_back_exactly(model):
    r = random.Random(2)
    for k in range(40):
        paragraphs = [" ".join(r.choice(["rain", "fell", "&", "hill<", "on", "cafés"]) for _ in range(r.randint(15, 60))) for _ in range(r.randint(3, 8))]
        page = "<body><nav><ul><li><a href=/a>a</a></li><li><a href=/b>b</a></li></ul></nav><div class='ad'>Buy.</div><article>" + "".join(f"<p>{html.escape(p)}" for p in paragraphs) + "</article><footer>&copy; x</footer>"
        assert page_content.texts([page], model) == ["\n".join(paragraphs)]


def brute(rows, k, scale=256.0):
    fine = [(i, np.floor(scale * np.asarray(v)).astype(int)) for i, v in rows if i is not None and v is not None and v and None not in v and np.isfinite(v).all()]
    out = set()
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 1e-3), (3, 300.0)])
def test_top_k_equals_brute_force(spark, seed, spread):
    r = np.random.default_rng(seed)
    x = r.normal(size=(700, 12)) * spread
    x[100:160] = x[7]                                                     # ties
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(None, rows[3][1]), (1000, None), (1050, [1.0, None] * 6), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (1200, []), (1250, [0.0] * 12), (1300, [1.0, 2.0]), (1301, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score").repartition(3)
    got = topk_index.top_k(df, df.where("vec_id % 50 = 0"))
    assert {(g.query_id, g.rank, g.vec_id, g.score) for g in got.collect()} == brute(rows, 5)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_index.top_k(none, none).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk_index.top_k(one, one).count() == 0
