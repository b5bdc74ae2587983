import html
import re

import numpy as np
import pytest
from boardwalk.llm import html_blocks
from boardwalk.llm.ship import ship

FOLDER = "/root/testdata/sf0.01"
LONG = "Some words of the story that go on for a while, so that it is a real paragraph of the text. "


@pytest.fixture
def pages(spark):
    ship(spark)
    return lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, words int, block string")


def text_of(page):
    found = html_blocks.blocks(page)
    main = html_blocks.train().predict(html_blocks.figures(found))
    return [b.text for b, m in zip(found, main.tolist(), strict=True) if m]


def test_blocks_of_bad_markup():
    page = "<title>t &amp; t</title><script>if (a<b) '</p>'</script><p>One\n <b>two<br>three<p>four &eacute;&#x41;&amp;lt; &amp <!-- <p>no</p> --> five<ul><li>a<li>b</ul>tail <a href='>'>x y</a> 1 < 2<style>p{"
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["One two three", "four éA&lt; & five", "a", "b", "tail x y 1 < 2"]
    assert (found[-1].words, found[-1].linked) == (6, 2)
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p> \n&nbsp;</p><!-- open") == []


def test_parts_that_are_not_the_article():
    page = f"""<html><body class="page sidebar-left"><header><a href=/>Home</a><p>{LONG}</p></header>
    <nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookieBanner"><p>{LONG}</p></div>
    <div id="page-wrapper"><div class="article-body"><h1>Title</h1><p>{LONG}A&nbsp;b.</p><div class="ad-slot">{LONG}</div><p>Ok.</p>
    <p hidden>{LONG}</p><p style="color:red">Red <a href=/c>link</a>.</p><aside><p>{LONG}</p></aside>
    <section id="comments"><h3>Comments</h3><article><p>{LONG}</p></article></section></div>
    <div class="widget">{LONG}</div></div><form action=/s><p>{LONG}</p><input name=q></form>
    <div role="contentinfo"><p>{LONG}</p></div></body></html>"""
    assert text_of(page) == ["Title", f"{LONG}A b.", "Ok.", "Red link."]


def test_pages_without_any_container():
    page = f"<div><a href=/>Home</a></div><div><a href=/n>News of today</a></div><div><h1>Title of it</h1><p>{LONG * 3}</p><p>{LONG * 2}</p></div><div><a href=/i>Imprint and more</a></div>"
    assert text_of(page) == ["Title of it", LONG.strip() + (" " + LONG.strip()) * 2, LONG.strip() + " " + LONG.strip()]
    assert text_of("Only text.") == ["Only text."]


def test_tree_learns_its_table_and_layouts_it_has_not_seen():
    rows, labels = html_blocks.labelled_table()
    assert (html_blocks.train().predict(rows) == labels).mean() > 0.99
    wrong = total = 0
    for left_out in range(0, len(html_blocks.PAGES), 6):
        rest = html_blocks.PAGES[:left_out] + html_blocks.PAGES[left_out + 6 :]
        rows, labels = html_blocks.labelled_table(html_blocks.PAGES[left_out : left_out + 6])
        wrong += int((html_blocks.train(rest).predict(rows) != labels).sum())
        total += len(labels)
    assert wrong < 0.15 * total  # every layout has something that no other has


def test_tree_splits_by_least_impurity():
    rows = np.array([[1.0, 5], [2, 5], [3, 1], [4, 1], [5, 1], [6, 5]])
    tree = html_blocks.Tree(rows, np.array([0, 0, 1, 1, 1, 0]), least=1)
    assert len(tree.share) == 3 and tree.feature[0] == 1 and tree.cut[0] == 3
    assert tree.predict(rows).tolist() == [False, False, True, True, True, False]


def test_every_page_of_the_table(spark, pages):
    """Brute force: the given pages have one article of paragraphs, so patterns can cut it out."""
    pages([])
    given = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {}
    for row in given.collect():
        article = re.sub("</?b>", "", re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]).replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        want[row.page_id] = "\n\n".join(p for p in parts if p)
    got = html_blocks.extract(given).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_nulls_repeats_long_pages_and_empty_tables(pages):
    long = "<article>" + "".join(f"<p>{LONG}{i}</p>" for i in range(5000)) + "</article>"
    rows = [(None, None, "<p>x y z</p>"), (1, "u", None), (2, "u", ""), (3, "u", "<article><p>same</p>"), (3, "u", "<article><p>same</p>"), (4, "v", long)]
    got = html_blocks.extract(pages(rows)).collect()
    assert sorted((r.page_id or -1, r.url or "", r.text[:5], r.n_chars) for r in got if r.page_id != 4) == [(-1, "", "x y z", 5), (1, "u", "", 0), (2, "u", "", 0), (3, "u", "same", 4), (3, "u", "same", 4)]
    (whole,) = [r.text for r in got if r.page_id == 4]
    assert whole.count("\n\n") == 4999
    assert html_blocks.extract(pages([])).count() == 0
    table = html_blocks.block_table(pages(rows)).collect()
    assert sum(r.main for r in table if r.page_id == 4) == 5000 and html_blocks.block_table(pages([])).count() == 0
