import time
import tracemalloc

import pytest

from tidemark.llm import main_text, queries

ARTICLE = "<article><h1>A walk &amp; a talk</h1><p>We  left\n early <b>in</b> the morning and went along the river for hours.</p><p>Nobody&#39;s boat was out, so the water lay still until the evening came down.</p></article>"
WANTED = "A walk & a talk We left early in the morning and went along the river for hours. Nobody's boat was out, so the water lay still until the evening came down."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = '<footer>Copyright, all rights reserved</footer>'


def texts(pages):
    return list(main_text.main_texts(pages, main_text.trained()))


def test_article_among_boilerplate():
    page = f'<html><head><title>T</title><style>p {{}}</style></head><body>{NAV}<div class="ad">Buy now and save</div>{ARTICLE}<div class="comments"><p>First!</p><p>I was there too.</p></div><script>var x = "<p>no</p>";</script>{FOOT}</body></html>'
    assert texts([page]) == [WANTED]


def test_pages_without_main_text():
    assert texts([None, "", "<html></html>", f"<html><body>{NAV}{FOOT}</body></html>"]) == [""] * 4
    assert texts([]) == []


def test_broken_mark_up():
    page = f"<body>{NAV}<div class=content><p>We left early in the morning and went along the river for hours.<p>Nobody was out, so the water lay still until the evening.</i></div></div>{FOOT}<p"
    assert texts([page])[0].startswith("We left early") and "Copyright" not in texts([page])[0]


def test_no_choice_contradicts_an_ancestor():
    for page in [main_text._made(main_text.random.Random(k))[0] for k in range(40)]:
        nodes = main_text.parse(page)
        kept = main_text.decode(nodes, main_text.odds(*main_text.features(nodes), main_text.trained()))
        assert all(n.parent is None or id(n.parent) in kept for n in nodes if id(n) in kept)


def test_held_out_pages():
    """Pages of another seed: words of the article begin with z, all others with m."""
    rng, hits, found, wanted = main_text.random.Random(99), 0, 0, 0
    for _ in range(200):
        page, mark = main_text._made(rng)
        got = texts([page])[0].split()
        hits += sum(w.startswith(mark) for w in got)
        found += len(got)
        wanted += sum(w.startswith(mark) for w in " ".join(c for n in main_text.parse(page) for c in n.children if isinstance(c, str)).split())
    assert hits / found > 0.95 and hits / wanted > 0.95


def test_query_and_edges(spark, sf):
    rows = queries.op8_main_text(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) for r in rows)
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, ARTICLE * 2000, None)], "page_id long, url string, html string, n_chars string")
    got = main_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"] > 0) for r in got.collect()) == [(0, True), (1, False), (1, False)]
    assert main_text.extract(pages.where("1 = 0")).count() == 0


def test_names_that_tell_nothing():
    """Classes of no known kind: what is main text shows in the tags and the amounts of text and links."""
    links = "".join(f'<li><a href="/{k}">Go {k}</a></li>' for k in range(8))
    page = f'<body><div class="qx17"><ul>{links}</ul></div><div class="zz9 k-3">{ARTICLE[9:-10]}</div><div class="qx18"><ul>{links}</ul></div>{FOOT}</body>'
    assert texts([page]) == [WANTED]


@pytest.mark.parametrize("page", ["<a " * 200_000, "<div>" * 200_000 + "</p>" * 200_000, "<b>" * 100_000 + "<li></li>" * 100_000, "<td><div>" + "<b>" * 100_000 + "<td></td>" * 100_000, '<a x="' * 200_000, "<" * 300_000, "<svg><foreignobject>" + "<g>" * 100_000 + "<b>" * 100_000])
def test_broken_pages_are_read_in_linear_time(page):
    began = time.process_time()
    main_text.parse(page)
    assert time.process_time() - began < 15


def test_tags_as_browsers_read_them():
    read = lambda page: [(n.tag, sorted(n.words)) for n in main_text.parse(page)[1:]]
    assert read("<div/><p>a</p>") == [("div", []), ("p", [])] and main_text.parse("<div/><p>a</p>")[2].parent.tag == "div"
    assert read('<div class="a > b" id=c><p data-x=don\'t class=d>x') == [("div", ["a", "b", "c"]), ("p", ["d"])]
    assert [n.children for n in main_text.parse("a < b and 1 <2 <!-- no --> c<!x> d")] == [["a < b and 1 <2 ", " c", " d"]]


def test_elements_without_text_end_where_browsers_end_them():
    body = f"<body>{NAV}{ARTICLE}{FOOT}</body>"
    whole = f"<html><head><title>T</title></head>{body}</html>"
    assert texts([whole]) == [WANTED]
    pages = [
        f"<html><head><title>T</title><meta charset=x><script>var a = '<p>';</script>{body}</html>",
        f"<html><head><title>T</title>{NAV}{ARTICLE}{FOOT}</html>",
        f"<head><noscript><img src=x></noscript>{body}",
        f'<body><svg viewBox="0 0 1 1"/>{NAV}{ARTICLE}{FOOT}</body>',
        f"<body>{NAV}<svg/>{ARTICLE}<svg><path d=x /></svg>{FOOT}</body>",
        f"<body>{NAV}<svg><g><path d=x>{ARTICLE}{FOOT}</body>",
        f"<body>{NAV}<svg><title/><text>no</text></svg>{ARTICLE}{FOOT}</body>",
        f"<body>{NAV}<div><noscript>no</div>{ARTICLE}{FOOT}</body>",
        f"<body>{NAV}<div><iframe src=x></div>{ARTICLE}{FOOT}</body>",
        f"<body>{NAV}<div><template><p>no</div>{ARTICLE}{FOOT}</body>",
        f"<body>{NAV}<noscript><p>no</p></noscript><iframe>no</iframe><template><a>no</template>{ARTICLE}{FOOT}</body>",
    ]
    assert [(k, t) for k, t in enumerate(texts(pages)) if t != WANTED] == []
    assert [n.tag for n in main_text.parse(whole)] == [n.tag for n in main_text.parse(f"<html>{body}</html>")]


def test_pages_of_many_nodes(monkeypatch):
    """Texts don't depend on which pages are scored together; what is held grows with the nodes of a batch, not of all pages."""
    long = "<html><body><article>" + "".join(f"<div class='c{k % 7}'><p>zword <a href=x>link</a> more words in line {k}.</p></div>" for k in range(1000)) + "</article><div class='footer'><p>m</p></div></body></html>"
    pages = [long, None, "<p>short</p>", long, ""] * 4
    together = list(main_text.main_texts(pages, main_text.trained()))
    monkeypatch.setattr(main_text, "NODES", 1)
    assert list(main_text.main_texts(pages, main_text.trained())) == together
    tracemalloc.start()
    assert sum(1 for _ in main_text.main_texts((long for _ in range(60)), main_text.trained())) == 60
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
