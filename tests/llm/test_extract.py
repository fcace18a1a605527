import re
from html import unescape

from panelcast.llm import extract

PARA = "This paragraph of the article is long enough to be told from menus."
CASES = {
    None: "", "": "", "<p></p>": "", "plain &amp; simple": "plain & simple", "<script>var x='<p>no</p>'": "",
    f"<nav><a href=a>Home</a></nav><article><h1>Title</h1><p>{PARA}<p>two\n  &lt;b&gt; <b>x</b><br>y</article><footer>(c)</footer>": f"Title\n{PARA}\ntwo <b> x y",
    f"<div class='menu'><a href=a>One</a> <a href=b>Two</a></div><div id=content><p>{PARA}</p><p>{PARA} Again.</p></div><div class='cookie-notice'>We use cookies on this long notice here.</div>":
        f"{PARA}\n{PARA} Again.",
    f"<main><p>{PARA}</p><form><label>Name</label></form><aside>side words</aside><ul><li>a</li><li>b</li></ul><section id='comments'><p>I liked it</p></section></main><p>out</p>": f"{PARA}\na\nb",
    f"<article><p>{PARA}<!-- <p>hidden</p> --><style>p{{}}</style></p><div class='ad'>Buy now</div><p>last</p>": f"{PARA}\nlast",
    f"<ul><li><a href=x>only links here</a></li></ul><div><p>{PARA}</p></div>": PARA,
}


def test_cases(spark):
    rows = [(i, None if i % 2 else "u", html, 1) for i, html in enumerate(CASES)] + [(0, "u", None, 1), (None, "v", "<p>x</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = extract.extract(pages).collect()
    assert len(out) == len(rows) and out[-1]["text"] == "x"
    wanted = list(CASES.values())
    for r in out[:-2]:
        assert r["text"] == wanted[r["page_id"]] and r["n_chars"] == len(r["text"])
    assert not extract.extract(pages.limit(0)).collect()


def test_wrappers_that_only_mention_boilerplate_stay():
    page = f"<article><h1>Title</h1><p>{PARA}</p></article>"
    for word in ("has-sidebar", "no-sidebar", "comments-open", "with-banner", "sidebar", "widget"):
        assert extract.main_text(f"<body><div class='{word}'><nav><a href=a>Home</a></nav>{page}</div></body>") == f"Title\n{PARA}", word
    assert extract.main_text(f"<body class=x><div id='social'><p>{PARA}</p><p>{PARA}</p></div><div class=ad>Buy</div></body>") == f"{PARA}\n{PARA}"
    assert extract.main_text(f"<article><p>{PARA}</p><section class='side-effects'><p>They are mild.</p></section><div class='site-footer'>(c)</div></article>") == f"{PARA}\nThey are mild."
    assert extract.main_text(f"<article><p>{PARA}</p></article><aside><article>Teaser</article></aside><div id=comments><article>{PARA * 9}</article></div>") == PARA
    assert extract.main_text(f"<head><meta x><body><p>{PARA}</p>") == PARA


def test_forms_lose_their_controls_only():
    fields = "<label>Name</label><input><select><option>a</option></select><button>Go</button>"
    assert extract.main_text(f"<body><form><div><p>{PARA}</p><p>last</p>{fields}</div></form></body>") == f"{PARA}\nlast"
    assert extract.main_text(f"<form><main><p>{PARA}</p></main>{fields}</form>") == PARA


def test_no_block_of_the_article_is_lost():
    long = PARA * 8
    parts = "<ul><li>one</li></ul><table><tr><td>cell</td></tr></table><section><p>short</p></section><figure><p>shown</p></figure><p>end</p>"
    body = f"<p>{long}</p>{parts}"
    want = f"{long}\none\ncell\nshort\nshown\nend"
    menu = "<ul><li><a href=x>only links here</a></li></ul>"
    for page in (f"<body>{menu}<div id=content>{body}</div>{menu}</body>", f"<body>{menu}{body}{menu}</body>", f"<div><div>{body}</div></div>", body):
        assert extract.main_text(page) == want
    assert extract.main_text(f"{menu}<div><section><p>{long}</p></section><section><p>short</p></section></div>") == f"{long}\nshort"
    linked = f"<header><h1><a href=t>Title</a></h1></header><div><p>{long}</p></div><ul><li><a href=l>see one</a></li></ul><p><a href=m>see two</a></p>"
    assert extract.main_text(f"{menu}<article>{linked}</article>") == f"Title\n{long}\nsee one\nsee two"
    assert extract.main_text(f"{menu}<div class=post><h1><a href=t>Title</a></h1><p>{long}</p><ul><li><a href=l>see</a></li></ul></div>") == f"Title\n{long}\nsee"


def test_long_page_is_read_whole():
    html = "<article>" + "".join(f"<p>{PARA} {i}</p>" for i in range(20000)) + "</article>"
    assert extract.main_text(html).count("\n") == 19999


def test_registered_query_equals_the_article_of_every_page(spark):
    from panelcast.llm.queries import op7_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in op7_html_extraction(spark, "/root/testdata/sf0.01").collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


PARAGRAPH = "<p>" + "Plain words of an article that is long enough to be found by its lines. " * 4 + "</p>"


def text_of(html):
    return extract.main_text(html)


def test_quotes_count_after_an_equals_sign_only():
    plain = text_of(f"<body><article>{PARAGRAPH}{PARAGRAPH}</article></body>")
    assert len(plain) > 400
    for odd in ("<p title=it's>x</p>", '<p "stray>x</p>', "<b don't>x</b>"):
        assert plain in text_of(f"<body><article>{PARAGRAPH}{PARAGRAPH}{odd}</article></body>")
    assert "x > y" not in text_of(f'<body><article>{PARAGRAPH}<p title="x > y">z</p></article></body>')


def test_reader_comments_go_and_captions_stay():
    for mark in ('<article class="comment">{}</article>', '<div class="comment-content">{}</div>', '<ul class="commentlist"><li>{}</li></ul>', '<div id="disqus_thread">{}</div>'):
        out = text_of(f"<body><article>{PARAGRAPH}{PARAGRAPH}</article>{mark.format('<p>Nice read, said a reader.</p>')}</body>")
        assert "Plain words" in out and "said a reader" not in out, mark
    out = text_of(f"<body><article>{PARAGRAPH}<figure><img src=a.png><figcaption>What the picture shows.</figcaption></figure><p>so <math><mi>x</mi></math> holds</p>{PARAGRAPH}</article></body>")
    assert "What the picture shows." in out and "so x holds" in out


def test_stray_closers_on_a_deep_page_are_linear():
    import time
    page = lambda n: "<b>" * n + "</i>" * n + PARAGRAPH
    text_of(page(100))
    start = time.perf_counter()
    text_of(page(20_000))
    assert time.perf_counter() - start < 5
