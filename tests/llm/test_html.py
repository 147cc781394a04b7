import html as entities
import re

from riskledger.llm import html, registry
from tests_llm_rows import prose

PARAGRAPH = "This is the first paragraph of the article, and it has many of the words that are in the list, so that it goes on & on until it is over two hundred signs long, as it should be by now, or not at all."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Never this</title>{head}</head><body>{body}</body></html>"


def test_query_against_the_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = registry.QUERIES["op1_html"](spark, sf).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1].replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h\d)>", article))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_page_without_an_article_element():
    got = html.main_text(
        page(
            f"""<header><h1>The Site</h1></header><div id="cookie-notice"><p>{prose(1, 40)}</p></div><nav><ul><li><a href=a>Home</a></li></ul></nav>
            <form action=x><p>{prose(2, 40)}</p><input><select><option>one</select></form>
            <div class="content has-sidebar"><h2>The title</h2><p>{entities.escape(PARAGRAPH)}</p><p>Short&nbsp;one.</p><p>{prose(3, 60)} <a href=b>that it is</a>  1 &lt; 2</p></div>
            <div class="comments"><p>{prose(4, 50)}</p></div><aside><p>{prose(5, 50)}</p></aside><div role="navigation">{prose(6, 40)}</div>
            <footer>&copy; 2020 all rights of this and that {prose(7, 40)}</footer>"""
        )
    )
    assert got == ["The title", PARAGRAPH, "Short one.", f"{prose(3, 60)} that it is 1 < 2"]


def test_side_blocks_inside_the_article():
    got = html.main_text(
        page(
            f"""<article><header><h1>Title</h1></header><p>{prose(1, 60)}<div class="ad-slot">{prose(2, 50)}</div><p>Two.<aside>{prose(3, 50)}</aside>
            <ul><li>First of all<li>Second</ul><div class="related"><a href=x>More of it</a></div><section id=comments><article class="comment"><p>{prose(4, 50)}</p></article></section><p>End.</article>"""
        )
    )
    assert got == ["Title", prose(1, 60), "Two.", "First of all", "Second", "End."]


def test_markup_that_is_no_text():
    got = html.main_text(
        page(
            f"""<main><script>if (a < b) {{ "</p>" }}</script><style>p {{}}</style><!-- <p>no</p> --><noscript><p>{prose(1, 40)}</p></noscript><template>x</template>
            <textarea><p>{prose(2, 50)}</p></textarea><svg><text>no</text></svg><p title="a > b" data-x='<p>'>{prose(3, 60)}</p><p hidden>{prose(4, 60)}</p><p style="display: none">{prose(5, 60)}</p>
            <p>a&#8217;b &eacute;&amp;lt; in<b>line</b> &#x1F600; {prose(6, 40)}</p><pre>  kept   as one\n line </pre></main>"""
        )
    )
    assert got == [prose(3, 60), f"a’b é&lt; inline \U0001f600 {prose(6, 40)}", "kept as one line"]


def test_link_lists_and_foreign_text_are_bad():
    links = "".join(f'<li><a href="{i}">{prose(i, 12)}</a></li>' for i in range(9))
    junk = " ".join(f"zq{i}x" for i in range(60))
    got = html.main_text(page(f"<div><p>{prose(1, 60)}</p><ul>{links}</ul><div>{junk}</div><p>{prose(2, 60)}</p></div>"))
    assert got == [prose(1, 60), prose(2, 60)]


def test_broken_and_odd_pages():
    assert html.main_text("") == [] and html.main_text("<") == [] and html.main_text("<p") == [] and html.main_text("<!--") == []
    assert html.main_text(f"<article><p>{prose(1, 40)}") == [prose(1, 40)]
    assert html.main_text(f"<article><p>{prose(1, 40)}</div></b></article></p>") == [prose(1, 40)]
    assert html.main_text(f"<ARTICLE><P CLASS=it's>{prose(1, 40)}</P></ARTICLE>") == [prose(1, 40)]
    assert html.main_text("<article>" + "<b>" * 3000 + f"<p>{prose(1, 40)}</p></article>") == [prose(1, 40)]


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", f"<article>{PARAGRAPH}</article>", "x"), (None, "u", f"<article>{prose(1, 30000)}</article>", "x"), (2, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((str(r.id), str(r.url), r.text) for r in html.extract(pages).collect())
    assert got == sorted([("1", "None", ""), ("2", "u", ""), ("2", "u", ""), ("2", "u", PARAGRAPH), ("None", "u", prose(1, 30000))])
    assert html.extract(pages.where("false")).count() == 0
