import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import url_filter as U


def by_regex(glob, s):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return re.fullmatch("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts), s) is not None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=8), min_size=1, max_size=30), st.lists(st.text("ab/cé", max_size=12), min_size=1, max_size=8))
def test_automaton_like_regex(globs, texts):
    got = U.GlobAutomaton(globs).match(texts)
    assert [[by_regex(g, t) for g in globs] for t in texts] == got.tolist()


def test_many_words_of_states():
    r = random.Random(2)
    globs = ["".join(r.choice("abc?*/") for _ in range(12)) for _ in range(60)]
    texts = ["".join(r.choice("abc/") for _ in range(r.randint(0, 30))) for _ in range(200)] + ["a" * 20_000]
    assert [[by_regex(g, t) for g in globs] for t in texts] == U.GlobAutomaton(globs).match(texts).tolist()


def test_query_and_odd_rows(spark):
    rows = [(1, "http://A.example.net/en/1?x", "u", 0), (2, "https://x.example.com/de/2", "u", 0), (3, "x.org/fr/", "u", 0), (4, None, "u", 0), (5, "http://a.org/fr/z#q", "u", 0), (6, "http://net", "u", 0), (7, "http://casino.example.com/a", "u", 0), (7, "http://casino.example.com/a", "u", 0), (8, "", "u", 0), (9, "a://b://c.net/x", "u", 0), (None, "http://É.net/" + "p" * 50_000, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, id int")
    got = {(r.page_id, r.host, r.path[:9], r.rule, r.verdict) for r in U.url_verdicts(df).collect()}
    assert got == {
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "x.example.com", "/de/2", "example.com/de/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "a.org", "/fr/z", "org/fr/", "allow"), (6, "net", "", None, "allow"), (7, "casino.example.com", "/a", None, "block"), (8, "", "", None, "allow"), (9, "b:", "//c.net/x", None, "allow"), (None, "É.net", "/pppppppp", "net/", "block"),
    }
    assert len(U.url_verdicts(df).collect()) == len(rows) and U.url_verdicts(df.limit(0)).count() == 0


def test_block_list_over_host_and_path(spark):
    globs = U.block_globs()
    assert len(set(globs)) == len(globs) > 200
    r = random.Random(4)
    hosts = ["a.example.com", "ads.b.com", "x.track.y.io", "my-casino.de", "pixel7.com", "c.example.org", "cdn-assetsX.com"]
    parts = ["casino", "casino-tips", "pokers", "poker", "top-poker", "file.exe", "a.zip", "download", "tag", "click", "x.js", "banner.gif", "casinoes", "en", "malware.html", "lottery.php"]
    urls = [r.choice(hosts) + "".join("/" + r.choice(parts) for _ in range(r.randint(0, 4))) for _ in range(800)]
    want = [any(by_regex(g, u) for g in globs) for u in urls]
    assert want == [any(re.fullmatch(U.glob_regex(g), u) for g in globs) for u in urls] and 100 < sum(want) < 780
    df = spark.createDataFrame([(i, f"http://{u}?q=casino") for i, u in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: x.verdict for x in U.url_verdicts(df).collect()}
    assert [got[i] for i in range(len(urls))] == ["block" if w else "allow" for w in want]
