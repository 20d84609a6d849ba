"""Embeddings, pages, components and the pipeline."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from schemaloom.llm import embedding_dedup, html_extract, oracles, work
from schemaloom.llm.components import Groups, connected
from schemaloom.llm.queries import queries, table
from schemaloom.llm.work import Marks, Tables, pack, rises, unpack

SF = "/root/testdata/sf0.001"


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x = np.concatenate([x, x[:60] + 0.05 * rng.standard_normal((60, 16)), x[:40] * 3, np.repeat(x[5:6], 50, axis=0) + 0.02 * rng.standard_normal((50, 16)), x[7:8], x[7:8]]).astype(np.float32)
    rows = [(i * 7 % 1013, v.tolist(), 1, "e", 2) for i, v in enumerate(x)]
    odd = [(2001, None), (2002, []), (2003, [0.0] * 16), (2004, [float("nan")] + [1.0] * 15), (2005, [None] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [float("inf")] * 16), (None, x[0].tolist()), (2009, [1e-30] * 16), (2010, [2e-30] * 16)]
    rows += [(i, v, 0, "e", 2) for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, node int").repartition(6)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.components(spark, df).collect()}
    ids = np.array([r[0] for r in rows[: len(x)]] + [2009, 2010])
    y = np.concatenate([x.astype(np.float64), np.ones((2, 16))])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    order = np.argsort(ids)
    groups = Groups(len(ids))
    i, j = np.nonzero(near[np.ix_(order, order)])
    groups.link(i, j)
    top = ids[order][groups.tops()]
    want = {int(ids[o]): (int(near[o].sum()) - 1, int(t), bool(ids[o] == t)) for o, t in zip(order, top, strict=True)}
    want |= {i: (0, i, True) for i in (2001, 2002, 2003, 2004, 2005, 2008)} | {2006: (1, 2006, True), 2007: (1, 2006, False), None: (0, None, True)}
    assert got == want
    assert embedding_dedup.components(spark, df.where("false")).count() == 0
    assert embedding_dedup.keep_one(spark, df).columns == df.columns


def test_repeated_ids_keep_all_their_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted(tuple(r) for r in embedding_dedup.components(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.id)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (4, 0, 4, True)]


def test_passes_find_planted_pairs(spark):
    """Pairs at cosine 0.95 to 0.97 among vectors in even directions, and in a crowd around one direction."""
    rng, n, d = np.random.default_rng(8), 6000, 64
    centre = rng.standard_normal(d) / 8
    for crowd in (0.0, 1.2):
        x = rng.standard_normal((n, d)) / 8 + crowd * centre
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        aside = rng.standard_normal((n // 4, d))
        aside -= (aside * x[: n // 4]).sum(axis=1, keepdims=True) * x[: n // 4]
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        c = rng.uniform(0.951, 0.97, (n // 4, 1))
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, c * x[: n // 4] + np.sqrt(1 - c * c) * aside]))]
        out = embedding_dedup.components(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).where(f"id >= {n}")
        assert out.where("n_links > 0").count() >= 0.99 * (n // 4)


def test_passes_follow_the_count():
    each = [embedding_dedup.passes_for(n, 0.95, 0.999, 256) for n in (10, 10**4, 10**6, 10**9)]
    assert each == sorted(each) and each[0] == 4 and each[-1] > 60


PAGE = """<!DOCTYPE html><html><head><title>x</title><script>if (a<b) {}</script><style>p{}</style></head><body><header><h1>Site</h1><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></header>
<div class="cookie-notice">We use cookies to make it all better <button>OK</button></div>
<div id=content><h2>The title &amp; more</h2><p>This is the <b>fir</b>st   paragraph with words that go on for a while.</p><div class="advert">Buy now this thing cheap</div>
<p>Second a &lt; b paragraph, which has some&nbsp;more text in it.<br>After a break.</p><form><input name=x>Sign up here</form><p>Third one has text also, a fair amount of it.</p></div>
<div class="sidebar"><p>Popular posts are here with many words in running text</p></div><section class="comments"><p>I like this article so much thanks for it</p></section><footer>Copyright some words</footer></body></html>"""
TEXT = "The title & more This is the first paragraph with words that go on for a while. Second a < b paragraph, which has some more text in it. After a break. Third one has text also, a fair amount of it."


def test_pages_with_and_without_learned_weights(spark):
    pages = table(spark, SF, "pages")
    learned = html_extract.learn(pages)
    for weights in (html_extract.Weights(), learned):
        assert html_extract.segment(PAGE, weights) == TEXT
        assert html_extract.segment("plain words only", weights) == "plain words only" and html_extract.segment("<p>a</p><!-- x", weights) == "a"
        assert html_extract.segment("<script>x", weights) == "" and html_extract.segment("<nav>only a menu</nav>", weights) == ""
    out = html_extract.extracted(spark, pages, learned)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    import html
    import re

    for r, p in zip(out.orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


def site_page(rng, marked):
    """(html, text) of a site whose class names no list has; only marked pages have an <article>."""
    words = lambda n: " ".join(rng.choice(["tavo", "belin", "gorra", "misk", "runa", "pelt"]) + rng.choice(["", "s", "en"]) for _ in range(n))
    menu = lambda: '<div class="mulo"><ul>' + "".join(f'<li><a href="/{k}">{words(2)}</a>' for k in range(rng.randrange(4, 20))) + "</ul></div>"
    aside = lambda: f'<div class="zept"><p>{words(rng.randrange(10, 80))}</p></div>'
    text = [words(rng.randrange(15, 60)) for _ in range(rng.randrange(3, 12))]
    story = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
    story = f'<div class="qavo">{f"<article>{story}</article>" if marked else story}</div>'
    before, after = [menu(), aside()], [aside(), f'<div class="drik"><p>{words(20)}</p></div>', menu()]
    rng.shuffle(before)
    rng.shuffle(after)
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before)}{story}{''.join(after)}</body></html>", " ".join(text)


def test_names_are_learned_from_marked_pages(spark):
    """200 pages with an <article> teach what 200 pages without one need, of names that no list has."""
    rng = random.Random(1)
    some = [site_page(rng, k < 200) for k in range(400)]
    df = spark.createDataFrame([(k, "u", p) for k, (p, _) in enumerate(some)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_extract.extracted(spark, df, html_extract.learn(df)).collect()}
    assert sum(got[k] == t for k, (_, t) in enumerate(some)) >= 392
    untaught = [html_extract.segment(p, html_extract.Weights()) == t for p, t in some[200:]]
    assert sum(untaught) < 100


def test_pages_without_marks(spark):
    """The corpus' pages with their <article> written as a plain <div>."""
    import html

    pages = table(spark, SF, "pages")
    learned = html_extract.learn(pages)
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", body))).split())
        assert html_extract.segment(p.html.replace("<article>", "<div>").replace("</article>", "</div>"), learned) == want


def test_an_article_after_a_long_menu_stays():
    article = "<article><p>The text of the article goes on for some words.<p>And then some more of them.</article>"
    for page in ("<nav><ul>" + "<li><a href=/>Entry</a>" * 10_000 + "</ul></nav>" + article, "<aside>" + "<div>x" * 10_000 + "</aside>" + article, "<ul><li class=advert>Buy<li>" + article + "</ul>"):
        text = html_extract.segment(page, html_extract.Weights())
        assert text == "The text of the article goes on for some words. And then some more of them."
        assert html_extract.counts_of(page)["t:p", True] == 2


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "", "t"), (3, "u", "<article>&#xD800; &#128512; ok &bogus; fine</article>" * 2, "t"), (4, "u", "<div " * 3000, "t"), (5, "u", "<p>" + "long words " * 100_000, "t")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extracted(spark, df, html_extract.learn(df)).collect()}
    assert out[1].text == "" and out[None].n_chars == 0 and "😀 ok &bogus; fine" in out[3].text and out[5].n_chars == 1_099_999
    assert html_extract.extracted(spark, df.where("false"), html_extract.learn(df.where("false"))).count() == 0


def test_components(spark):
    rng, tables = random.Random(3), Tables(spark, "test")
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(600, 900)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    groups = Groups(1400)
    groups.link(*np.array(links).T)
    tops, nodes = groups.tops(), {n for p in links for n in p} - {7}
    got = {r.node: r.component for r in connected(tables, spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: int(tops[n]) for n in nodes}
    assert connected(tables, spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing_and_marks():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 1000, dtype=np.uint64))
    y = np.arange(1000, dtype=np.int32)
    a, b = unpack(pack(rises(x), y), 1000, "u8", "i4")
    assert (np.cumsum(a, dtype=np.uint64) == x).all() and (b == y).all()
    assert [len(z) for z in unpack(pack(x[:0], y[:0]), 0, "u8", "i4")] == [0, 0]
    marks = Marks(4, 512)
    for r in range(4):
        own = x[Marks.range_of(x, 4) == r]
        marks.bits[r * 512 : (r + 1) * 512] = np.frombuffer(Marks.segment(own, 512), np.uint8)
    assert marks.has(x).all() and marks.has(x + np.uint64(1)).mean() < 0.2


@pytest.mark.parametrize("name", [n for n in queries() if n != "pipeline" and n not in oracles.SQL])
def test_queries_run(spark, name):
    out = queries()[name](spark, SF)
    key = {"op1_embedding_dedup": "embeddings", "op7_html_extraction": "pages"}.get(name, "documents")
    assert out.count() == table(spark, SF, key).count()


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = Tables(spark, "stage").cut(stage(spark, docs, SF))
        seen[name] = (before.count(), docs.count())
        if name != "bpe":
            assert docs.columns == columns
    assert seen["toxicity"][0] > seen["toxicity"][1] and seen["line_dedup"][0] == seen["line_dedup"][1] and seen["simhash_near_dedup"][0] > seen["simhash_near_dedup"][1] and seen["bpe"][0] == seen["bpe"][1]
    assert corpus_pipeline.run(spark, SF).count() == seen["bpe"][1]
    odd = [(1, None, None, None, None), (None, "a text of words", "en", "s", 15), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "Some line\nSome line", "en", None, 19)]
    frame = rows = spark.createDataFrame(odd, table(spark, SF, "documents").schema)
    want = {
        # No document with labels: nothing is rejected. The second of two equal lines goes. The empty texts are alike, and
        # the first, which has no text, stays; a null id stays. Texts without words are never taken.
        "toxicity": odd, "line_dedup": [*odd[:4], (3, "Some line", "en", None, 9)], "simhash_near_dedup": [odd[0], odd[1], (3, "Some line", "en", None, 9)],
        "mixing": [odd[1], (3, "Some line", "en", None, 9)],
    }
    for name, stage in corpus_pipeline.STAGES:
        rows = Tables(spark, "stage").cut(stage(spark, rows, SF))
        if name in want:
            got = Counter(tuple(r) for r in rows.drop("n_chars").collect())
            expected = Counter(r[:4] for r in want[name])
            assert set(got) == set(expected) and (name == "mixing" or got == expected), name
    assert {r.doc_id: (r.n_tokens > 0, len(r.ids) == r.n_tokens) for r in rows.collect()} == {None: (True, True), 3: (True, True)}
    none = frame.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = Tables(spark, "stage").cut(stage(spark, none, SF))
        assert none.count() == 0


def test_work_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(work, "shared_dir", lambda _: f"file://{tmp_path}")
    with Tables.passing():
        Tables(spark, "inner").cut(spark.range(3))
        Tables(spark, "other").cut(spark.range(3))
        assert len(list(tmp_path.iterdir())) == 2
    assert not list(tmp_path.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = [p for p in tmp_path.iterdir() if any(x.is_dir() for x in p.iterdir())]
    assert [p.name.split("-")[0] for p in left] == ["pipeline"] and len([x for x in left[0].iterdir() if x.is_dir()]) == 1


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        work.shared_dir(Session())
    Context.master = "local[2]"
    assert work.shared_dir(Session()) == work.shared_dir(Session())


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(oracles.SQL[name])
    names = [d[0] for d in found.description]
    out = queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in out.collect()) == sorted(found.fetchall())
