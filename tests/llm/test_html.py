"""Wrapper inference and extraction on hand-made pages."""

from barspark.llm import html_wrappers as h
from barspark.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article id="post-%d"><h1>Head %d &eacute; &amp;lt;</h1><p>One <b>two</b>three<br>four <!-- c <p> --><script>if(a<b){"</article>"}</script>
<div class="ad-box">Buy <p>now</p></div><ul><li>a<li>b</ul>%s<p>last &nbsp; x < y
<section id="comments"><p>nice!</p></section></article><aside>side</aside><form><p>f</p></form><footer>foot</footer></body></html>"""
PLAIN = """<html><body><div class="top">Same words on all pages</div><div id="x"><p>Story %d goes</p><p>on and on %s</p></div>
<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></body></html>"""


def test_extraction(spark, tmp_path_factory):
    pages, want = [], {}
    for i in range(12):
        pages.append((i, f"http://art.example/{i}", PAGE % (i, i, "<p>more</p>" * (i % 4)), "clash"))
        want[i] = " ".join(f"Head {i} é &lt; One twothree four a b {'more ' * (i % 4)}last x < y".split())
        pages.append((100 + i, f"http://plain.example/{i}", PLAIN % (i, "w" * i), "clash"))
        want[100 + i] = f"Story {i} goes on and on {'w' * i}".strip()
    pages += [(200, None, None, ""), (201, "http://art.example/e", "", ""), (202, "x", "<p>lone &amp; text", ""),
              (203, "http://art.example/n", "<body>no article <nav>m</nav> here</body>", ""), (204, "y", "<<<>>> < &bogus;", ""),
              (205, "http://big.example/", "<article>" + "<p>w</p>" * 20000 + "</article>", ""), (0, pages[0][1], pages[0][2], "")]
    want |= {200: "", 201: "", 202: "lone & text", 203: "no article here", 205: " ".join(["w"] * 20000)}
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(4).write.parquet(f"{path}/pages.parquet")
    got = queries.op2_html_wrappers(spark, path).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in want:
            assert r.text == want[r.page_id], r.page_id
    wrappers = h.infer_wrappers(spark.read.parquet(f"{path}/pages.parquet"), fan_in=2).collect()
    assert len(wrappers) == len({r.host for r in wrappers}) and sum(r.pages for r in wrappers) == len(pages)


def test_alignment_makes_optional_repeated_and_slots():
    w = None
    for body in ("<h1>A</h1><p>x</p>", "<h1>B</h1><p>y</p><p>z</p>", "<h1>C</h1><hr><table><tr><td>1</table><p>q</p>"):
        tree = h.page_tree(f"<body><div>same</div>{body}</body>")
        w = h.merge(w, tree) if w else tree
    assert h.expression(w) == "<body><div>'same'</><h1>#text</>(<table><tr><td>'1'</></></>)?(<p>#text</>)+</>"


def test_wrapper_size_is_bounded():
    w = h.page_tree("".join(f"<x{i}>t</x{i}>" for i in range(500)))
    assert len(w[h.KIDS]) <= h.WIDEST + 1
    for k in range(30):
        w = h.merge(w, h.page_tree("".join(f"<y{k}{i}>t</y{k}{i}><p>" for i in range(40))))
    assert len(w[h.KIDS]) <= h.WIDEST + 1


def extracted(spark, tmp_path_factory, pages):
    """page_id -> text of (page_id, url, html) rows."""
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(f"{path}/pages.parquet")
    return {r.page_id: r.text for r in queries.op2_html_wrappers(spark, path).collect()}


def word(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:04d}")


def test_hundreds_of_article_labels(spark, tmp_path_factory):
    pages = [(i, f"http://wide.example/{i}", f"<body><div><p>{'Constant words. ' * 10}</p></div><article class='tag-{word(i)} x{word(i * 7)}'>"
              f"<p>Story {i} {'goes on ' * 20}</p></article><span>byline {i}</span></body>") for i in range(400)]
    got = extracted(spark, tmp_path_factory, pages)
    assert all(got[i] == f"Story {i} {'goes on ' * 20}".strip() for i in got) and len(got) == 400


def test_folded_labels_keep_their_mass():
    kids = "".join(f"<div class='{word(i)}'><p>{'w' * 10}</p></div>" for i in range(300)) + "<b>x</b>"
    w = h.page_tree(kids)
    assert h.total(w, h.MASS) == 3001 and len(w[h.KIDS]) <= h.WIDEST + 1
    for k in range(5):
        w = h.merge(w, h.page_tree(kids.replace("class='", f"class='{word(k)} ")))
    assert h.total(w, h.MASS) == 6 * 3001 and len(w[h.KIDS]) <= h.WIDEST + 1


def test_template_text_is_whole_and_on_different_pages(spark, tmp_path_factory):
    lead = "The same opening words of every page of this host, well over sixty-four characters, then story "
    pages = [(i, f"http://lead.example/{i}", f"<body><div class='c'><div class='top'>{'Constant words ' * 6}</div><div class='x'>{lead}{word(i)}</div></div></body>")
             for i in range(30)]
    copy = "<body><div class='c'><h1>Head</h1><div class='lead'>Lead words</div><div class='x'>Body words</div></div></body>"
    pages += [(100 + i, f"http://copy.example/{i}", copy + f"<!-- {i} -->" * (i % 2)) for i in range(40)]
    got = extracted(spark, tmp_path_factory, pages)
    assert all(got[i] == f"{lead}{word(i)}" for i in range(30))  # the constant text is still cut
    assert {got[100 + i] for i in range(40)} == {"Head Lead words Body words"}


def test_class_words_leave_out_no_main_text(spark, tmp_path_factory):
    story = "Story text goes on and on. " * 10
    side = "<div class='sidebar'><article>teaser one</article><article>teaser two</article></div>"
    cases = {
        0: (f"<div class='layout has-sidebar'><article><p>{story}</p></article>{side}</div>", story),
        1: (f"<div class='ad-free'><main><p>{story}</p></main></div><div class='ad'>Buy</div>", story),
        2: (f"<div class='social page'><p>{story}</p></div><div class='share'>Share this</div>", story),
        3: (f"<article><div class='entry-header'><h1>Head</h1></div><p>{story}</p></article><div class='header'>Site</div>", "Head " + story),
        4: (f"<article><h1>Head</h1><div class='story social'><p>{story}</p></div></article>", "Head " + story),
        5: (f"<article><p>Short.</p><section id='comments'><article class='comment-body'>{story}</article></section></article>", "Short."),
        6: (f"<article><p>Short.</p></article><div class='ad'>{story}</div>", "Short."),
        7: (f"<article><p>Short.</p></article><section class='comments'><article class='comment-body'>{story}</article></section>", "Short."),
        8: (f"<div class='page no-comments'><p>{story}</p></div>", story),
        9: (f"{side}<div class='content'><p>{story}</p></div>", story),
        10: (f"<div class='related'><div class='layout sidebar'><article>{story}</article><div class='sidebar'>x</div></div></div>", story),
        11: (f"<div class='layout has-sidebar'><article>{story}</article><section class='comments'><article>nice</article></section></div>", story),
    }
    pages = [(k, f"http://case{k}.example/", f"<body>{page}</body>") for k, (page, _) in cases.items()]
    got = extracted(spark, tmp_path_factory, pages)
    assert {k: got[k] for k in cases} == {k: want.strip() for k, (_, want) in cases.items()}


def test_empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    assert queries.op2_html_wrappers(spark, path).count() == 0


def test_deep_nesting(spark, tmp_path_factory):
    deep = "<div>" * 600 + "low words %d" + "</div>" * 600 + "<p>end %d</p>"
    pages = [(i, "http://deep.example/", f"<body>{deep % (i, i)}</body>") for i in range(3)]
    pages.append((9, "http://deeper.example/", "<body>" + "<div class=x>" * 20_000 + "far <b>in</b>"))
    pages.append((10, "http://deeper.example/", "<body>" + "<div class=y>" * 5_000 + "<nav>menu</nav>text" + "</div>" * 5_000 + "after"))
    got = extracted(spark, tmp_path_factory, pages)
    assert got == {i: f"low words {i} end {i}" for i in range(3)} | {9: "far in", 10: "text after"}


def test_depth_of_a_wrapper_leaves_the_text():
    page = lambda n: "<body><div>head</div>" + "<div>" * n + "a <a href=1>b</a> c" + "</div>" * n + "tail</body>"
    assert len({h.main_text(page(n), "body", frozenset()) for n in (1, h.DEEPEST - 2, h.DEEPEST, h.DEEPEST + 1, 500)}) == 1
    masses = [[h.total(h.page_tree(page(n)), k) for k in (h.MASS, h.LINKS)] for n in (1, h.DEEPEST - 1, h.DEEPEST, 300)]
    assert masses == [masses[0]] * 4


def test_comments_and_teasers_as_articles(spark, tmp_path_factory):
    story = "A story of some words that goes on for a while."
    comment, teaser = "<article class='comment-body'>nice read</article>", "<article class='teaser'>Next: other things</article>"
    cases = {
        1: (f"<article><p>{story}</p></article><div class='thread'>{comment * 3}</div>", story),
        2: (f"<article><p>{story}</p></article>{teaser * 4}", story),
        3: (f"<div class='story'><p>{story}</p></div><div class='thread'>{comment * 2}</div>", story),
        4: (f"<article class='post no-comments'><p>{story}</p></article>", story),
        5: (f"<article class='post promo'><p>{story}</p></article><div>x</div>", story),
        6: (f"<main><p>{story}</p>{comment}</main>", story),
    }
    pages = [(k, f"http://case{k}.example/", f"<body>{page}</body>") for k, (page, _) in cases.items()]
    assert extracted(spark, tmp_path_factory, pages) == {k: want for k, (_, want) in cases.items()}
