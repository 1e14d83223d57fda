"""Near-duplicate vectors against brute force; main text of pages."""

import numpy as np
import pytest
from locusframe.llm import forest, htmltext


def brute(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [[] for _ in rows]
    for i in ok:
        for j in ok:
            a, b = rows[i][1], rows[j][1]
            if i != j and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].append(j)
    comp = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        comp.append(min(ids) if ids else None)
    return [(r[0], len(links[i]), comp[i], r[0] is not None and comp[i] == r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("max_leaf", [4096, 7])
def test_forest(spark, max_leaf):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    near = [b + rng.standard_normal(16) * s for b in base[:12] for s in (0.05, 0.1, 0.2, 0.3)]
    dense = [base[0] + rng.standard_normal(16) * 0.05 for _ in range(30)]
    vectors = [list(map(float, v.astype(np.float32))) for v in [*base, *near, *dense]]
    rows = list(enumerate(vectors)) + [(900, vectors[3]), (901, vectors[3]), (902, None), (903, []), (904, [0.0] * 16), (905, [1.0] * 15 + [None]), (906, [float("nan")] + [1.0] * 15), (907, [1.0] * 8), (908, [2.0] * 8), (5, vectors[5]), (None, vectors[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as c", "2 as v", "3 as w").repartition(2)
    got = [tuple(r) for r in forest.near_duplicates(df, trees=12, leaf=20, max_leaf=max_leaf).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_forest_finds_links_far_beyond_its_sample(spark):
    """Leaves split below the sample: 6 levels here. Pairs are planted at a cosine just above the threshold."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 64))
    side -= (side * base[:1000]).sum(axis=1, keepdims=True) * base[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([base, 0.953 * base[:1000] + np.sqrt(1 - 0.953**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    tree = forest.Tree(64, 1).fit(x[:100], 4, 0.02, 6)
    assert len(set(tree.route(x, 0.02)[1].tolist())) > 8 * sum(np.isnan(tree.threshold)) / 4
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicates(df, leaf=20, sample=100).collect()}
    near = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert near.sum() >= 2000 and all(got[i] <= near[i] for i in got)
    assert sum(got.values()) >= 0.98 * near.sum()


def test_pairs_count_where_they_meet_first(monkeypatch):
    rng = np.random.default_rng(2)
    for n, most in ((40, 300), (1, 5), (30, 3), (200, 70)):
        places = [np.unique(rng.integers(0, most, rng.integers(0, 9))) for _ in range(n)]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        want = [not set(places[a]) & set(places[b]) for a, b in zip(i.tolist(), j.tolist())]
        for many in (1 << 13, 64):
            monkeypatch.setattr(forest.Meetings, "PLACES", many)
            assert forest.Meetings(places).first(i, j).tolist() == want


def test_forest_joins_hot_vectors_by_broadcast(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(100 + i, [float(i + 1), -1.0]) for i in range(3)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (49, 0) for i in range(50)) and len(got) == 53


def test_forest_gives_the_rows_of_its_sql(spark, tmp_path):
    from oracle import compare

    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    near = [b + rng.standard_normal(8) * 0.1 for b in base[:10] for _ in range(3)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near])] + [(500, None), (501, [0.0] * 8), (502, [1.0] * 7 + [None]), (503, [float("inf")] * 8), (3, base[3].tolist()), (504, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert compare(forest.near_duplicates(df, leaf=20), forest.SQL, tmp_path) == len(rows)


def test_forest_empty(spark):
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now at half the price.</div>
<article><h1>Rivers &amp; towns</h1><p>The river  runs
by the &eacute;glise,<br>past <b>old</b> mills.<p>Another <i>paragraph</i> of some length, which nobody closed.</p><div class="comments"><p>Reply: nice one!</p></div></article>
<form><label>Mail</label><button>Send</button></form><footer>&copy; example.org &middot; All rights reserved.</footer></body></html>"""


def test_blocks():
    got = [b.text for b in htmltext.blocks(PAGE)]
    assert got == ["Home", "About", "Buy now at half the price.", "Rivers & towns", "The river runs by the église, past old mills.", "Another paragraph of some length, which nobody closed.", "Reply: nice one!", "Mail", "Send", "© example.org · All rights reserved."]
    assert htmltext.blocks(None) == htmltext.blocks("") == htmltext.blocks("<script>x") == []
    assert [b.text for b in htmltext.blocks("just text < 3 & more")] == ["just text < 3 & more"]
    assert len(htmltext.blocks("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


def test_pages_that_are_not_well_formed():
    got = lambda h: [b.text for b in htmltext.blocks(h)]
    assert got("<p>body <noscript>x <p>more") == ["body", "x", "more"]
    assert got("<svg><svg></svg>gone</svg><p>kept") == got("<svg><p>kept") == ["kept"]
    assert got("<div>a<script>b<p>c") == ["a"]
    deep = htmltext.blocks("<nav>" + "<i>" * 400 + "menu</nav><p>text")
    assert [b.text for b in deep] == ["menu", "text"] and not deep[1].path & htmltext._bit("t:nav")
    assert got("<p><div>" + "<span>" * 30000 + "x" + "</p>" * 30000) == ["x"]
    assert got("<svg>" * 30000 + "x") == ["x"]


def test_a_very_long_page(spark):
    page = PAGE.replace("</article>", "<p>The river goes on and on, past many towns.</p>" * 20000 + "</article>")
    got = htmltext.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got["n_chars"] == len(got["text"]) and got["text"].count("on and on") == 20000


def test_main_text_of_no_pages(spark):
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (1, "u", PAGE)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")).collect()
    want = "Rivers & towns\n\nThe river runs by the église, past old mills.\n\nAnother paragraph of some length, which nobody closed."
    assert sorted(map(repr, [tuple(r) for r in got])) == sorted(map(repr, [(i, u, want if h else "", len(want) if h else 0) for i, u, h in rows]))


def test_held_out_accuracy():
    w, wrong, n = htmltext.trained(), 0, 0
    for html in htmltext.synthetic(150, 77):
        page = htmltext.blocks(html)
        y = [htmltext.MARK in b.text for b in page]
        for b in page:
            b.text = b.text.replace(htmltext.MARK, "")
        if page:
            p = htmltext.label(w, [page])[0] >= 0.5
            wrong += int((p != np.array(y)).sum())
            n += len(y)
    assert wrong / n < 0.01


def test_pages_of_the_test_data():
    import html as h
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    for got, page in zip(htmltext.extract(htmltext.trained(), pages), pages):
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(h.unescape(re.sub(r"<br>", " ", s).replace("<b>", "").replace("</b>", "")).split()) for s in re.split(r"</?(?:p|h1)>", body)]
        assert got == "\n\n".join(filter(None, parts))
