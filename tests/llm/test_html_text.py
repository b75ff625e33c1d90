import html
import re
import time

import pytest

from factorloom.llm import html_text

LONG = "This is a paragraph of running text that goes on for a while and says quite a few things about its subject, as paragraphs do. "
PAGES = {
 'sidebar':('<body class="single-post has-sidebar"><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>' + LONG + '</p><p>Short.</p></article><aside><p>Other</p></aside></body>','Title\n' + LONG.strip() + '\nShort.'),
 'open':('<body class="home comments-open"><article class="post no-ads"><h1>T</h1><p>One.</p><div class="comments"><p>' + LONG + '</p></div></article></body>','T\nOne.'),
 'main':('<main class="search-main"><h2>T</h2><p>x</p></main>','T\nx'),
 'noheader':('<div class="no-header"><article><p>abc</p></article></div>','abc'),
 'wrap':('<div class="post-share-wrap"><article><p>abc</p><section class="related-work"><p>def</p></section></article></div>','abc\ndef'),
 'plain':('<div><a href="a">Home</a></div><div><a href="b">News</a></div><div>A title of words</div><div>' + LONG * 2 + '</div><div>Short line.</div><div>' + LONG * 2 + '</div><div><a href="c">More</a></div><div>Imprint</div>','A title of words\n'+(LONG * 2).strip()+'\nShort line.\n'+(LONG * 2).strip()),
 'svg':('<article><p>a</p><svg viewBox="0 0"/><p>b</p><math/><select-box>c</select-box><style-guide>d</style-guide><p>e</p></article>','a\nb\nc\nd\ne'),
 'names':('<div id="page"><div class="site-header"><p>Site</p></div><div class="cookie-banner">' + LONG + '</div><div class="entry-content"><header class="entry-header"><h1>T</h1></header><p>Text.</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><div class="ad-slot">buy</div></div><div id="comments" class="comment-list"><p>' + LONG + '</p></div><div class="site-footer">' + LONG + '</div></div>','T\nText.\none\ntwo\nc1\nc2'),
 'one':('<p>'+'word '*5000+'</p>',('word '*5000).strip()),
 'entities':('<article><p>a &lt;b&gt; &#233;&nbsp;x &amp;amp; y<p>1 < 2 > 0</article>','a <b> é x &amp; y\n1 < 2 > 0'),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_labelled_pages(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


def test_the_tree_uses_blocks_and_neighbours():
    used = set()

    def walk(node):
        if not isinstance(node, bool):
            used.add(html_text.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html_text.tree())
    assert {"words", "linked", "words_before", "words_after", "place"} <= used
    x, y = html_text.labelled()
    assert sum(html_text.is_content(html_text.tree(), row) == bool(label) for row, label in zip(x, y)) >= 0.97 * len(y)


def test_every_article_of_the_table_whole(spark):
    """Against a plain reading of the articles' tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got == want


@pytest.mark.parametrize("piece", ['<a "x ', "<a ' \" >", "</x>", "<div>", "<svg>", "<!--", "<script ", '<a href="x>y" ', "<![CDATA[", "< "])
def test_time_grows_with_the_page(piece):
    start = time.time()
    html_text.main_text("<p>a</p>" + piece * 100_000)
    assert time.time() - start < 5
