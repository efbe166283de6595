import pytest

from cobframe.llm import wrappers
from tests.llm.helpers import SF, prose

SCHEMA = "page_id long, url string, html string, text string, host string, pattern string"


def page(i, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><script>var a='</p><p>no';</script></head><body>"
            f"<div class=\"site-header\"><a href=/>Home</a> Daily Paper</div><nav><ul><li><a href='/{i}'>n{i}</a></li></ul></nav>"
            f"<div class='ad'>buy {i}</div><div class=content><h1>Head {i}</h1>{body}<p>Read more stories like this</p></div>{extra}"
            f"<aside>side {i}</aside><form>mail {i}<input name=q></form><div id=comments><p>first! {i}</p></div>"
            f"<footer>&copy; {i}</footer></body></html>")


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA)


def texts(spark, rows, **how):
    return {r["page_id"]: r["text"] for r in wrappers.main_text(frame(spark, rows), **how).collect()}


def test_template_and_roles_go_and_slots_stay(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<p>Body {i} &amp; <b>bold</b>\n one<br>two<p>Second {i}")) for i in range(12)]
    got = texts(spark, rows)
    assert got[3] == "Head 3\nBody 3 & bold one two\nSecond 3"
    # without pages enough there is no template: the repeated line stays
    assert texts(spark, rows[:3])[1] == "Daily Paper" * 0 + "Head 1\nBody 1 & bold one two\nSecond 1\nRead more stories like this"


def test_article_element_bounds_the_text(spark):
    html = "<div>outside</div><article><header><h2>T</h2></header><p>in &lt;b&gt; &#233;<ul><li>x<li>y</ul><pre>p\n q</pre></article>tail"
    assert texts(spark, [(1, "u", html)])[1] == "T\nin <b> é\nx\ny\np q"


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<p>a<!-- no <p>b --></p>c", "a\nc"),
    ("<script>never ended <p>x", ""), ("a<br/>b", "a b"), ("<div hidden>x</div>y", "y"), ("</div></p>x", "x"),
    ("<p>&nbsp;a&nbsp;&nbsp;b </p>", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("2 < 3 > 1", "2 < 3 > 1"),
    ("<p><b>open<br><p>next</b> on", "open\nnext on"),
    ("<article class='post tag-news'><p>story</article><article class=comment><p>first!</article>", "story"),
    ("<div class='post tag-search-news'>story</div><div class='nav-bar'>x</div>", "story")])
def test_awkward_html(spark, html, text):
    assert wrappers.text_of(wrappers.tree(html or ""), set()) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='social-history'><h1>Clubs</h1><p>Real article text</p></div>", "Clubs\nReal article text"),
    ("<div class='side-by-side'><p>Two columns</p></div>", "Two columns"),
    ("<section id='related-work'><h2>Related work</h2><p>They found</p></section>", "Related work\nThey found"),
    ("<div class=content><p>Main story</p></div><article class=teaser><p>Teaser.", "Main story\nTeaser."),
    ("<div class='social-links'><a href=x>Follow us</a></div><p>y", "y"), ("<div class=related><p>More</p></div><p>y", "y"),
    ("<div class='ad-slot'><p>Buy</p></div><p>y", "y"), ("<p>x <a href='cut", "x"), ("<p>x <a b c <i>d</i>", "x d"),
    ("<p title='a > b' data-x=\"<p>\">x</p>", "x"), ("<p a=\"b\"c='d'e>x</p>", "x"), ("<p ='x>y", "y"), ("it's <b id=q'>ok", "it's ok")])
def test_roles_and_broken_tags(html, text):
    assert wrappers.text_of(wrappers.tree(html), set()) == text


@pytest.mark.parametrize("html", [
    "<p>x</p><div " + 'a a="b" ' * 1000, "<a a=\"b\" " * 3000 + " <", "<a b=\"" * 20_000, "<" * 50_000, "<a='" * 20_000 + "\"" * 20_000])
def test_broken_tags_take_no_time(html):
    import time
    start = time.process_time()
    wrappers.text_of(wrappers.tree(html), set())
    assert time.process_time() - start < 2


def test_induction_alone_changes_texts(spark):
    """Pages without any telling tag, class or id."""
    rows = [(i, f"http://plain.example/{i}", f"<html><body><div><div>Daily Herald of the North</div><div><p>{prose(50 + i, 20)}</p>"
             f"<p>{prose(900 + i, 14)}</p></div><div>Printed in the old town since 1871</div></div></body></html>") for i in range(9)]
    got = texts(spark, rows)
    assert all(got[i] == f"{prose(50 + i, 20)}\n{prose(900 + i, 14)}" for i in range(9))
    assert "Daily Herald" in texts(spark, rows, least_pages=100)[3]


def test_edges_of_the_table(spark):
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    long = "".join(f"<p>{prose(i, 12)}</p>" for i in range(3000))
    rows = [(None, None, page(1, "<p>x")), (1, None, None), (2, "not a url", ""), (3, "http://h/", deep), (4, "http://h/", long),
            (4, "http://h/", long), *((10 + i, "http://h/", page(i, f"<p>y {i}")) for i in range(8))]
    got = wrappers.main_text(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "core"
    assert by[4]["text"].count("\n") == 2999
    assert by[1]["text"] == "" and by[1]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrappers.main_text(frame(spark, [])).count() == 0


def test_simple_tree_matching_is_largest():
    def size(a, b):
        """The recurrence written out."""
        if not wrappers.alike(a, b):
            return 0
        m = [[0] * (len(b.below) + 1) for _ in range(len(a.below) + 1)]
        for i, x in enumerate(a.below, 1):
            for j, y in enumerate(b.below, 1):
                m[i][j] = max(m[i][j - 1], m[i - 1][j], m[i - 1][j - 1] + size(x, y))
        return m[-1][-1] + 1
    a = wrappers.tree(page(1, "<p>a<p>b<ul><li>x<li>y</ul>"))
    b = wrappers.tree(page(2, "<p>a<ul><li>y</ul><p>c", "<div><p>more</div>"))
    pairs = wrappers.match(a, b)
    assert len(pairs) == size(a, b)
    assert len({x.number for x, _ in pairs}) == len({y.number for _, y in pairs}) == len(pairs)


def test_given_pages_give_their_articles(spark):
    got = wrappers.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert got and all(r["text"] and "<" not in r["text"][:50] for r in got)


def test_long_lists_match_as_short_ones_do():
    import random
    rnd = random.Random(8)

    def some(depth):
        return "".join(rnd.choice([f"<p>{rnd.randint(0, 6)}</p>", f"<p class=a>{rnd.randint(0, 3)}<b>x</b></p>", f"t{rnd.randint(0, 3)}<br>",
                                   f"<div>{some(depth - 1) if depth else 'e'}</div>"]) for _ in range(rnd.randint(0, 14)))

    for _ in range(60):
        a, b = wrappers.tree(some(3)), wrappers.tree(some(3))
        pairs = [[(x.number, y.number) for x, y in wrappers.match(a, b, **how)] for how in ({}, {"cells": 0}, {"cells": 20, "remember": 3})]
        assert pairs[0] == pairs[1] == pairs[2]


def test_constant_ends_of_long_flat_pages_go(spark):
    rows = [(i, f"http://flat.example/{i}", "<body>" + "".join(f"<p>{prose(1000 * i + k, 6)}</p>" for k in range(210 + 13 * i))
             + "<p>Read more stories like this</p><p>All rights reserved here</p></body>") for i in range(8)]
    got = texts(spark, rows)
    assert all("Read more" not in got[i] and "reserved" not in got[i] and got[i].count("\n") == 209 + 13 * i for i in range(8))


def test_every_layout_has_its_template(spark):
    def other(i):
        return (f"<html><body><div class=gallery><h1>Show {i}</h1><p>Look closer at the picture</p><p>Seen {prose(i, 9)}</p>"
                f"<p>Order a print from our shop</p></div></body></html>")
    rows = [(i, f"http://two.example/{i}", page(i, f"<p>Body {prose(i, 12)}")) for i in range(20)]
    rows += [(100 + i, f"http://two.example/s{i}", other(i)) for i in range(8)]
    rows += [(200 + i, None, page(i, f"<p>Body {prose(i, 12)}")) for i in range(7)] + [(300 + i, "no host", other(i)) for i in range(6)]
    got = texts(spark, rows)
    for start, n in ((100, 8), (300, 6)):
        assert all(got[start + i] == f"Show {i}\nSeen {prose(i, 9)}" for i in range(n))
    for start, n in ((0, 20), (200, 7)):
        assert all(got[start + i] == f"Head {i}\nBody {prose(i, 12)}" for i in range(n))
