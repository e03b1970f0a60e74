import pytest

from postlake.sources import paging as G
from postlake.sources.web import Start, read_pages

LISTS = "source string, section string, section_no long, url string"


def lists(spark, *urls):
    return spark.createDataFrame([("s", u, n, u) for n, u in enumerate(urls)], LISTS)


def site(spark, pages):
    return spark.createDataFrame(list(pages.items()), "url string, html string")


def got(out):
    return sorted((r.section, r.page_no, r.url if r.page_no >= 0 else "", r.html, r.error is not None) for r in out.collect())


def fetched(spark, pages, urls, tail, **how):
    """The same lists read from their site, page after page."""

    def fetch(url):
        if pages.get(url) is None:
            raise OSError("404")
        return pages[url]

    starts = [Start("s", u, u + tail, n, **how) for n, u in enumerate(urls)]
    return read_pages(spark, starts, fetch, 0)


NUMBERED = {f"a/{n}": "<button>1</button><button>3</button>" for n in range(1, 6)} | {"b/1": "<p>x", "b/2": "y", "c/1": "<button>9</button>", "c/2": "<button>9</button>", "d/1": "<button>2</button>", "d/2": None}
NEXT = {f"a/{n}": f"<p>{n}<a href='#' class='{'off disabled' if n == 4 else 'on'}'>Next</a>" for n in range(1, 7)} | {"b/1": "<a>Next</a>", "c/1": "none", "c/2": "never", "d/1": "<button>Next</button>", "d/2": "<button disabled>Next</button>"}
OFFSET = {f"a/{n}": '{"items": [1], "hasMore": true}' for n in range(0, 2000, 25)} | {"b/0": '{"items": [1], "hasMore": true}', "b/25": '{"items": [], "hasMore": true}', "c/0": '{"items": [2], "hasMore": true}', "d/0": '{"items": [2], "hasMore": false}', "d/25": "{}"}
GROW = {f"a/{n}": "<tr>" * min(n, 4) for n in range(1, 9)} | {f"b/{n}": "<tr>" * k for n, k in enumerate((1, 2, 2, 3, 3, 3), 1)} | {f"c/{n}": "<tr>" * n for n in range(1, 4)} | {"d/1": "none", "d/2": "none"}


@pytest.mark.parametrize("read, pages, how, web", [
    (G.by_numbers, NUMBERED, {}, {"paging": "numbered"}),
    (G.by_next, NEXT, {}, {"paging": "next"}),
    (G.by_next, NEXT, {"most": 2}, {"paging": "next", "most": 2}),
    (G.by_offset, OFFSET, {}, {"paging": "offset"}),
    (G.by_offset, OFFSET, {"last_offset": 50}, {"paging": "offset", "last_offset": 50}),
])
def test_as_fetched_page_after_page(spark, read, pages, how, web):
    names = ["a/", "b/", "c/", "d/", "none/"]
    tail = "{offset}" if read is G.by_offset else "{page}"
    assert got(read(lists(spark, *names), site(spark, pages), **how)) == got(fetched(spark, pages, names, tail, **web))


@pytest.mark.parametrize("rows, patience", [("<tr>", 1), ("<tr>", 2), ("", 1), ("<tr>", 3)])
def test_growth(spark, rows, patience):
    names = ["a/", "b/", "d/"] if patience == 1 else ["a/"] if patience == 3 else ["a/", "b/"]
    out = got(G.by_growth(lists(spark, *names), site(spark, GROW), rows, patience))
    assert out == got(fetched(spark, GROW, names, "{page}", paging="grow", rows=rows, patience=patience, most=500))
    # A list that still grew where the archive ends is not whole.
    assert got(G.by_growth(lists(spark, "c/"), site(spark, GROW), rows, patience)) == [("c/", -1, "", None, True)]


def test_links(spark):
    pages = {"http://h/a": "Ad <a title='Next' href='/b'>n</a>", "http://h/b": "Ad <a title='Next' href='c'>n</a>", "http://h/c": "none <a title='Next' href='c'>n</a>", "http://h/x": "Ad <a title='Next' href='gone'>n</a>", "http://h/r": "Ad <a title='Next' href='r'>n</a>"}
    names = ["http://h/a", "http://h/x", "http://h/r", "http://h/none"]
    out = got(G.by_links(lists(spark, *names), site(spark, pages), most=5, anchor="Ad"))
    assert out == got(fetched(spark, pages, names, "", paging="next", anchor="Ad", most=5))
    assert [x[1] for x in out if x[0] == "http://h/r"] == [0, 1, 2, 3, 4]


def test_single_pages_and_fallback(spark):
    archive = site(spark, {"a": "<p>one<p>two", "b": None})
    out = G.with_text(G.fetched(lists(spark, "a", "b", "c"), archive))
    assert sorted((r.section, r.page_no, r.body_text, r.error) for r in out.collect()) == [("a", 0, "one\ntwo", None), ("b", -1, None, "empty"), ("c", -1, None, "not archived")]
    other = G.with_text(G.fetched(lists(spark, "a", "b"), site(spark, {"a": "x", "b": "y"})))
    assert sorted((r.section, r.body_text) for r in G.with_fallback(out, other).collect() if r.body_text) == [("a", "one\ntwo"), ("b", "y")]
    assert G.by_numbers(lists(spark, "a/").limit(0), archive).count() == 0
