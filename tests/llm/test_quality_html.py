import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.llm import htmltext, quality


def _brute_isotonic(x, y):
    """Least squares over all nondecreasing step functions, by the max-min formula."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    values = np.unique(xs)
    means = lambda a, b: ys[(xs >= values[a]) & (xs <= values[b])].mean()
    return values, np.array([max(min(means(a, b) for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))])


def test_isotonic_fit_is_the_least_squares_one():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        x, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float)
        knots, levels = quality.isotonic(x, y)
        values, want = _brute_isotonic(x, y)
        assert np.allclose(np.interp(values, knots, levels), want) and (np.diff(levels) >= -1e-12).all()


def test_features_approximate_a_gaussian_kernel():
    _, _, turn, phase = quality._start(np.zeros((0, quality.WIDTH)))
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), turn, phase, np.zeros(1), np.zeros(1), np.zeros(1))
    x = np.random.default_rng(1).normal(size=(40, quality.WIDTH))
    z = model.waves(x)[:, 1:]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.BANDWIDTH**2))
    assert np.abs(z @ z.T - exact).mean() < 0.06


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "a", "." * 5000, "x " * 100_000, "😀É|!"])
def test_statistics_of_any_text(text):
    assert len(quality.statistics(text)) == quality.WIDTH and np.isfinite(quality.statistics(text)).all()


def _docs(spark, n=1200):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 120))]
        text = rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 40)]) if bad else " ".join(words) + ".\n" + " ".join(words[::-1]) + "."
        rows.append((i, text, i))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows + [(None, None, 0), (5, "", 0), (5, rows[5][1], 0)], "doc_id long, text string, score int"), spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = _docs(spark)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = quality.fit(docs, labels, only=~held)
    scored = quality.score(docs, model).where("doc_id <> 5").join(labels, "doc_id").where(held).collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.97 * len(scored)
    every = quality.score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in every)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in every)
    none = quality.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs.limit(5), none).collect()} == {0.5}
    good = quality.fit(docs, labels.where("quality = 1"))
    assert quality.keep(docs.where("doc_id > 10"), good).count() == docs.where("doc_id > 10").count() and quality.score(docs.where("false"), good).count() == 0


def test_the_whole_fit_is_that_of_plain_numpy(spark):
    docs, labels = _docs(spark, 300)
    docs = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id = 11"))
    model = quality.fit(docs, labels)
    marks = {r["doc_id"]: r["quality"] for r in labels.where("doc_id is not null and quality is not null").collect()}
    parts = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(quality.PARTS)).alias("p")).collect()}
    rows = [(r["text"], marks[r["doc_id"]], parts[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in marks]
    x, y, fold = np.array([quality.statistics(t) for t, _, _ in rows]), np.array([q for _, q, _ in rows], float), np.array([p % quality.FOLDS for *_, p in rows])
    rng = np.random.default_rng(7)
    turn, phase = rng.normal(0, 1 / quality.BANDWIDTH, (quality.WIDTH, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    centre, scale = x.mean(0), x.std(0)
    waves = lambda v: np.hstack([np.ones((len(v), 1)), np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((v - centre) / np.where(scale > 1e-9, scale, 1), -8, 8) @ turn + phase)])

    def weights(inside):
        z, free = waves(x[inside]), np.diag([0.0] + [1.0] * quality.FEATURES)
        return np.linalg.solve(z.T @ z + quality.RIDGE * inside.sum() * free, z.T @ y[inside])

    raw = np.zeros(len(x))
    for f in range(quality.FOLDS):
        raw[fold == f] = waves(x[fold == f]) @ weights(fold != f)
    values, levels = _brute_isotonic(np.round(raw, 6), y)
    texts = [r["text"] for r in docs.collect()]
    want = np.interp(waves(np.array([quality.statistics(t) for t in texts])) @ weights(np.ones(len(x), bool)), values, levels)
    got = model.score(quality.table(texts))
    assert np.abs(got - want).max() < 1e-3 and len(rows) > 330
    again = quality.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.levels, model.levels)


def test_a_key_with_many_rows_stays_within_the_sample(spark):
    docs, labels = _docs(spark, 200)
    many = docs.unionByName(spark.range(300).selectExpr("3L as doc_id", "concat('text ', id) as text", "0 as score"))
    small = quality.fit(many, labels, most=150)
    assert np.array_equal(small.weights, quality.fit(many.repartition(5), labels, most=150).weights)
    from vicinity.llm import rules

    assert rules.fit(many, labels, most=150) == rules.fit(many.repartition(5), labels, most=150)


def _page(body, head="<title>T</title><style>p{}</style><script>var a='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><!-- x -->{body}<footer>&copy; us</footer></body></html>"


def test_blocks_and_references():
    page = _page("<div class='ad'>Buy <b>now</b></div><article><h1>A &amp; B</h1><p>One\n two<br>three<p>Four <b>five&nbsp;six.</p><ul><li>l1<li>l2</ul><script>x</script><form><input>f</form></article>")
    path = next(p for p, *_ in htmltext.votes(page) if p.startswith("html/body/article#"))
    assert htmltext.extract(page, path) == htmltext.extract(page, None) == "A & B\n\nOne two three\n\nFour five six.\n\nl1\n\nl2"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "</div></p>", "plain &lt;text&gt;", "<div><div><div>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>" * 3000 + "x", "<div>" * 3000 + "deep"])
def test_any_markup_gives_a_text(page):
    assert isinstance(htmltext.extract(page, None), str) and isinstance(htmltext.votes(page), list)
    if page and page.startswith("plain"):
        assert htmltext.extract(page, None) == "plain <text>"


@pytest.mark.parametrize(("page", "text"), [('<p class="x>Hello</p>', "Hello"), ("<p title=it's>Hello</p>", "Hello"), ('<p class="x>Gone</p><p class="y">Hello</p>', "Hello"), ("a < b <c", "a < b"), ("</>x</ >y", "xy"), ("<div\n class=a id='b'/>t", "t"), ('<x"y>z', "z"), ("<a <b>c", "c"), ("<p a = 'b' c>t", "t"), ("<!-->a<!-- -->b", "ab"), ("<?x?>a<![CDATA[<b>]]>", "a<b>"), ("1 &lt; 2 < 3", "1 < 2 < 3")])
def test_odd_markup_is_read_as_browsers_do(page, text):
    assert htmltext.extract(page, None) == text


HOSTILE = {
    "nested": lambda n: "<div>" * n + "x", "quotes": lambda n: '<a href="' * n, "single": lambda n: "<a href='x" * n, "signs": lambda n: "<" * n, "cdata": lambda n: "<![CDATA[" * n, "comments": lambda n: "<!--" * n,
    "ends": lambda n: "<b><article>" + "<div>" * n + "</b>" * n, "paragraphs": lambda n: "<p>" * n, "items": lambda n: "<ul>" * n + "<li>x" * n, "attributes": lambda n: "<a " + 'x="y" ' * n + "x", "equals": lambda n: "<a " + "=" * n, "raw": lambda n: "<script>" * n, "cells": lambda n: "<table>" * n + "<td>x" * n, "amps": lambda n: "&" * n, "classes": lambda n: "<div class='" + "a" * n + "'>x", "steps": lambda n: "<div>" * (n // 2) + "<span>x</span>" * n,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_grows_with_the_length_of_a_page(kind):
    import time

    def took(n):
        start = time.process_time()
        page = HOSTILE[kind](n)
        for path, *_ in htmltext.votes(page)[:1] or [("#", 0, 0)]:
            htmltext.extract(page, path)
        return time.process_time() - start

    took(100)
    small, large = min(took(5_000) for _ in range(2)), took(40_000)
    assert large < 30 * small + 0.5  # eight times the page; quadratic: 64 times


def test_all_containers_of_a_page_vote():
    page = "<body>" + "".join(f"<div class='k{chr(97 + i)}'><p>{'word ' * (40 - i)}</p></div>" for i in range(20))
    got = htmltext.votes(page)
    assert len(got) == 21 and [w for *_, w in got] == sorted((w for *_, w in got), reverse=True) and got[-1][2] == 1


def test_large_tables_are_looked_up_by_split_keys(spark, monkeypatch):
    from vicinity.llm import common

    rows = spark.createDataFrame([(i, f"h{i % 7}" if i % 3 else "hot", f"t{i}") for i in range(600)] + [(-1, None, None)], "part long, host string, text string")
    table = common.save(spark.createDataFrame([("hot", 200, "p"), ("h1", 60, "q"), ("h2", 60, None), ("none", 1, "r")], "host string, n long, path string"), "table")
    small = common.look_up(rows, table, "host", "n", ["part", "text"])
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    large = common.look_up(rows, table, "host", "n", ["part", "text"])
    assert "Broadcast" in small._jdf.queryExecution().toString() and small.columns == large.columns
    key = lambda r: str(tuple(r))
    assert sorted(small.collect(), key=key) == sorted(large.collect(), key=key) and large.count() == 601


def test_unwanted_parts_stay_out():
    text = "Sentence of the story. " * 20
    parts = ["<div class='cookie-notice'>C</div>", "<aside>S</aside>", "<div id='comments'><p>R</p></div>", "<section class='related'>L</section>", "<div role='search'>Q</div>", "<div class='share-buttons'>H</div>", "<div style='display: none'>N</div>", "<header>T</header>"]
    page = _page("".join(parts) + f"<div class='story-body'><p>{text}</p>{parts[2]}{parts[0]}<p>End.</p></div>" + "".join(parts))
    assert htmltext.extract(page, htmltext.votes(page)[0][0]) == text.strip() + "\n\nEnd."


def test_layout_names_around_the_whole_page_do_no_harm():
    story = "Sentence of the story. " * 20
    for wrap in ("<div class='page with-sidebar'>%s</div>", "<div class='has-menu'><div id='header-large'>%s</div></div>"):
        page = _page(wrap % f"<div class='sidebar'><p>Side</p></div><div class='content'><p>{story}</p></div><div class='comments'><p>{'Reader. ' * 200}</p></div>")
        assert htmltext.extract(page, htmltext.votes(page)[0][0]) == story.strip()


def test_hosts_agree_on_a_path(spark):
    story = lambda k: f"<div class='main c{k}'><div class='post p{k}'><p>{'Long story words. ' * 30}</p></div><div class='box'><p>{'side words ' * 3}</p></div></div>"
    odd = "<div class='main c1'><div class='post p1'><p>short</p></div><div class='box'><p>" + "much longer box text " * 40 + "</p></div></div>"
    rows = [(i, "http://H.test/a", _page(story(1))) for i in range(5)] + [(7, "https://h.test/b", _page(odd)), (8, None, _page(story(2))), (9, "http://h.test/x", None), (10, "http://other.test/", "<p>only this</p>"), (None, "http://h.test/", ""), (0, "http://h.test/a", _page(story(1)))]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    paths = {r["host"]: r["path"] for r in htmltext.host_paths(pages).collect()}
    assert "/div.main/div.post#" in paths["h.test"]
    got = htmltext.main_texts(pages)
    texts = {r["page_id"]: r["text"] for r in got.collect()}
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    assert texts[7] == "short" and texts[9] == texts[None] == "" and texts[10] == "only this" and texts[0] == ("Long story words. " * 30).strip()
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect()) and htmltext.main_texts(pages.where("false")).count() == 0


def test_test_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmltext.main_texts(pages).collect()}
    for r in pages.collect():
        inside = re.search("(?s)<article>(.*?)</article>", r["html"])[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", re.sub("<br>", " ", x)))).strip() for x in re.split("</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)
