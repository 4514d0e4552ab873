from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.html_extract import extract, main_text, op1_html_extract, regions

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Home</a></li></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><h1>Title &amp; more</h1><p>First   line<br>goes on.<p>Caf&eacute;&nbsp;&#8212; <b>bo</b>ld<!-- x --> end.<div class="ad">Buy</div><p>Short.
<section class="comments"><p>Reader says hi</p></section></article><aside>Side</aside><form><p>Mail?</p></form><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Title & more First line goes on. Café — bold end. Short."


def test_page_without_article_by_distribution():
    body = "".join(f"<p>{'word ' * 30}{i}.</p>" for i in range(4))
    page = f"<html><body><div><a href=x>One</a></div><div><a href=y>Two</a></div><div></div>{body}<div id=footer>end</div></body></html>"
    text = main_text(page)
    assert text.startswith("word") and text.endswith("3.") and "One" not in text and "end" not in text


def test_ends_early_and_odd_input():
    assert main_text("<article><p>kept &am") == "kept &am"
    assert main_text("<article><p>kept <b class='x") == "kept"
    assert main_text("plain words") == "plain words"
    assert main_text("") == main_text(None) == main_text("<p></p>") == ""
    assert main_text("<article>" + "<p>a b</p>" * 50_000) == " ".join(["a b"] * 50_000)


def test_rows_and_columns_stay(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == 3 and sorted(r.text for r in found)[0] == "" and found[0].text.startswith("Title")
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_names_that_only_start_like_a_part_keep_their_text():
    page = '<article><p>T</p><div class="share-your-story">My story.</div><section id="related-work">Earlier work.</section><p>End.</p></article>'
    assert main_text(page) == "T My story. Earlier work. End."
    for name in ("share-buttons", "related-posts", "comment-list", "ad-google", "google-ad", "sidebar-left", "comments__item", "post-comments"):
        assert main_text(f'<article><p>T</p><div class="{name}">gone</div></article>') == "T", name
    assert main_text('<article><p>T</p><div class="related-reading"><a href="x">Another one</a></div></article>') == "T"
    prose = "word " * 60
    assert main_text(f'<body><div><a href=x>One</a></div><div class="social-security">{prose}</div></body>') == prose.strip()


def test_lengths_decide_beside_articles():
    story = "".join(f"<p>{'long story ' * 40}{i}.</p>" for i in range(4))
    teasers = "".join(f"<article><p>Teaser {i}</p></article>" for i in range(3))
    text = main_text(f"<body><div>Home page</div><div></div>{'<div><a href=x>l</a></div>' * 3}{story}{teasers}</body>")
    assert "0." in text and "3." in text and text.endswith("Teaser 2") and "Home" not in text
    assert main_text(f"<body><article><p>Short.</p></article><div>{'small print ' * 20}</div></body>") == "Short."


def test_very_long_line_and_empty_table_of_the_query(spark, tmp_path):
    line = "word " * 400_000
    assert main_text(f"<article><p>{line}</p></article>") == line.strip()
    spark.createDataFrame([], "page_id long, url string, html string, text int").write.parquet(f"{tmp_path}/pages.parquet")
    assert op1_html_extract(spark, str(tmp_path)).columns == ["page_id", "url", "text", "n_chars"]
    assert op1_html_extract(spark, str(tmp_path)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 1, 5, 40, 90, 200]), max_size=40), st.integers(1, 5), st.sampled_from([1, 20, 86, 300]))
def test_regions_against_every_surge_and_dive(weights, window, surge):
    def total(i):
        return sum(w for j, w in enumerate(weights) if i <= j < i + window)

    # A line counts if some line up to it surges and no line from there to it dives.
    plain = [any(total(k) >= surge and all(total(j) > 0 for j in range(k, i + 1)) for k in range(i + 1)) for i in range(len(weights))]
    assert regions(weights, window, surge) == plain
