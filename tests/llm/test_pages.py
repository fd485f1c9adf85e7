from pyspark.sql import functions as F

from cellcast.llm import pages

PARAGRAPH = "This is a long paragraph of the article with many words in it, which says a lot of things. "


def test_article_without_what_surrounds_it():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script>
    </head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
    <!-- note --><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
    <article><h1>Title &amp; more</h1><p><b>Bold {PARAGRAPH}<br><p>Second
     &nbsp; block.</p><div class="comments"><p>First!</p></div><aside>Side</aside>
    <form><input>Send</form><p>Of.</p></article>
    <section id="comments"><p>{PARAGRAPH * 3}</p></section><footer>&copy; 2020</footer>"""
    assert pages.main_text(html) == "\n".join(
        ["Title & more", f"Bold {PARAGRAPH}".strip(), "Second block.", "Of."])


def test_regions_by_text_to_tag_ratio():
    body = "".join(f"<p>{PARAGRAPH * 3}</p>" for _ in range(6)) + "<p>Short.</p>"
    links = "".join(f"<div><a href=x>link {k}</a></div>" for k in range(30))
    html = f"<body><div>{links}</div><div>{body}</div><div>{links}</div></body>"
    text = pages.main_text(html)
    assert text.count("\n") == 6 and text.endswith("Short.") and "link" not in text


def test_teasers_marked_as_articles_do_not_hide_the_text():
    cards = "".join(f"<article><h3><a href=x>Card {k}</a></h3><p>Short teaser {k}.</p></article>" for k in range(6))
    body = "".join(f"<p>{PARAGRAPH * 3}</p>" for _ in range(6)) + "<p>Short.</p>"
    for html in (f"<body><div>{cards}</div><div>{body}</div></body>",
                 f"<body><main><div>{body}</div>{cards}</main></body>",
                 f"<body><main>{cards}<article><div><h1>Title</h1></div><div>{body}</div></article></main>"):
        text = pages.main_text(html)
        assert text.endswith("Short.") and text.count(PARAGRAPH.strip()) == 18 and "teaser" not in text
        assert text.startswith("Title") == ("<h1>" in html) and "Card" not in text


def test_link_list_inside_an_article():
    body = "".join(f"<p>{PARAGRAPH * 3}</p>" for _ in range(4))
    links = "".join(f"<li><a href=x>link {k}</a></li>" for k in range(12))
    text = pages.main_text(f"<article><h1><a href=x>Title</a></h1>{body}<ul>{links}</ul><p>Last.</p></article>")
    assert text.startswith("Title\n") and text.endswith("Last.") and "link" not in text


def test_paragraphs_in_containers_of_their_own():
    body = "".join(f"<div>{PARAGRAPH * n}</div>" for n in (1, 6, 2, 7, 1))
    text = pages.main_text(f"<body><div id=x><h2>Title</h2>{body}</div><div><p>One.<p>Two.</div>")
    assert text.startswith("Title") and text.count("\n") == 5 and "One." not in text


def test_smoothing_is_a_weighted_mean():
    import numpy as np

    x = np.array([0.0, 0, 10, 0, 0, 0])
    assert np.allclose(pages.smoothed(np.full(7, 3.0)), 3.0)
    assert abs(pages.smoothed(x).sum() - 10) < 1e-9 and pages.smoothed(x).argmax() in (1, 2)


def test_odd_pages(spark, clashing):
    rows = [(1, None), (2, ""), (3, "no markup at all"), (4, "<nav>menu</nav>"), (5, "<p>unclosed"),
            (6, "</p></div>stray"), (7, "<script>never closed <p>x</p>"), (8, "<p>" * 5000 + "deep"),
            (9, "<article><p>" + "word " * 200_000 + "</p></article>"), (9, "<p>twice</p>"),
            (None, "<p>&lt;b&gt; &#233; &bogus;</p>"), (10, "<div <p>a</p>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, html string"))
    got = pages.extract_text(df).select("page_id", F.coalesce("text", F.lit("null")).alias("text")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got if r.page_id != 9}
    assert [text[k] for k in (1, 2, 3, 4, 5)] == ["", "", "no markup at all", "", "unclosed"]
    assert text[6] == "stray" and text[7] == "" and text[8] == "deep" and text[None] == "<b> é &bogus;"
    assert max(len(r.text) for r in got if r.page_id == 9) == 999_999


def test_names_and_wrappers_lose_no_article():
    body = "<h1>Title</h1>" + "".join(f"<p>{PARAGRAPH * 2}</p>" for _ in range(4))
    foot = "<footer><p>Copyright of the site, all rights reserved by its owner.</p></footer>"
    want = "\n".join(["Title"] + [(PARAGRAPH * 2).strip()] * 4)
    for html in (f"<html><head><title>T</title><meta name=x>{body}{foot}",
                 f"<html><head><title>T</title><body><div>{body}</div>{foot}",
                 f"<div class='content no-sidebar'>{body}</div>{foot}",
                 f"<div id='page' class='has-header'>{body}{foot}</div>",
                 f"<main><div class='story share-enabled'>{body}</div></main>{foot}",
                 f"<form><div>{body}</div><label>Mail</label><select><option>One<option>Two</select></form>{foot}",
                 f"<div class='page-with-sidebar'><div class='widget'>Some words beside.</div><div>{body}</div></div>",
                 f"<div class=header><div>{body}</div></div><div>Short junk, unmarked.</div>"):
        assert pages.main_text(html) == want, html[:60]


def test_marked_paragraphs_beside_an_article():
    body = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(3))
    long = f"<p>{PARAGRAPH * 8}</p>" * 6
    for name in ("comments", "comment-replies", "reader-comments"):
        text = pages.main_text(f"<article>{body}<div class='{name}'>{long}</div></article>")
        assert text == "\n".join([PARAGRAPH.strip()] * 3), name
    for html in (f"<aside><p>{PARAGRAPH * 2}</p></aside>", f"<div class='cookie-notice'><p>{PARAGRAPH}</p></div>",
                 f"<p class='share'>{PARAGRAPH}</p>", f"<div class='site-footer'>{PARAGRAPH}</div>"):
        text = pages.main_text(f"<body><div>{body * 3}{html}{body}</div></body>")
        assert text == "\n".join([PARAGRAPH.strip()] * 12), html[:30]


def test_smoothing_decides(monkeypatch):
    long = f"<div>{PARAGRAPH * 4}</div>" * 3
    html = f"<body><div>{long}<div><b>A</b> <i>short</i> <b>line</b>.</div>{long}</div></body>"
    assert "A short line." in pages.main_text(html).split("\n")
    monkeypatch.setattr(pages, "smoothed", lambda ratios: ratios)
    assert "short" not in pages.main_text(html)


def test_weights_of_nested_marks():
    import numpy as np

    marks = [pages.Mark(), pages.Mark(0, 0.5, False), pages.Mark(1, 0.1, False), pages.Mark(0, 0.1, True)]
    got = pages.line_weights(marks, np.array([0, 1, 2, 3]), np.array([10.0, 10, 10, 10]))
    assert np.allclose(got, [1, 0.5, 0.05, 0.1])
    assert np.allclose(pages.line_weights(marks, np.array([1, 2, 3]), np.array([70.0, 10, 1])), [1, 0.1, 0.1])
    assert np.allclose(pages.line_weights(marks, np.array([3]), np.array([70.0])), [0.1])
