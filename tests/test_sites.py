import pytest

from postlake.operators import reconcile as R
from postlake.sources import html as H
from postlake.sources import sites as S
from postlake.sources.web import Start, pages, read_pages, with_fallback

POLYU = "<table><tr><th>Dept</th><th>Post</th><th>Project</th><th>Closing</th><th>Ref</th></tr><tr><td>Department of Music<td>Professor<td>Opera<td>27 February 2026<td>260213012</tr><tr><td>Law</td><td>Dean</td><td>2026-02-27</td><td>260213013</td></tr><tr><td>Law</td><td>Dean again</td><td>-</td><td>260213013</td></tr><tr><td>x</td><td>y</td></tr></table>"
EDUHK = "Department of Science\nLecturer in Physics\nRef: 250001\nAd Date: 1 Jan 2026\nClose Date: 5 Feb 2026\nNext\nFaculty of Arts\nSenior Tutor\nAd Date: 2 Jan 2026\nClose Date: N/A\n"
EDUHK_HTML = "<a href='/x'>x</a><a href='https://e/cms/f/career/1.pdf'>pdf</a>"
LINGNAN = "<a href='/ux/requisition/77?c=1'>Senior HR Officer, Human Resources Office</a><a href='/ux/requisition/78'>Senior HR Officer, Human Resources Office</a><a href='/requisition/79'>Dean of Arts</a><a href='/other'>Other thing</a>"
HKU = "<table><tr><td>529000</td><td><a href='/en/1'>Finance Officer</a></td><td>Finance Office</td><td>3 Mar 2026</td></tr><tr><td>529000</td><td><a href='/en/2'>Assistant Professor</a></td></tr><tr><td>529001</td><td><a href='/en/3'>Lecturer in Law</a></td><td>Faculty of Law</td><td>4 Mar 2026</td><td>2026-05-05</td></tr></table>"
HKUST = "School (3)\nLecturer in Maths\nJob ID: 101\nDepartment of Mathematics\nOpen Date: 2026-01-01\nApply by: 2026-03-01\nResearch Fellow\nJob ID: 102\nOpen Date: 2026-01-02\nLong line after\n"
HKUST_HTML = "<div><div class='card'><b>Lecturer</b><span>Job ID: 101</span><a href='https://apply.interfolio.com/9'>Apply</a></div><div class='card'><span>Job ID: 102</span></div></div>"
CITYU = "<table><tr><td><a href='/a?ref=A-1'>Professor</a></td><td>Dept of Physics</td><td>until filled</td></tr><tr><td><a href='/a?ref=A-1'>Professor</a></td><td>x</td></tr><tr><td><a href='http://c/b'>Dean of Law</a></td><td>Law</td></tr><tr><td><a href='http://c/c'>Dean of Law</a></td><td>Law</td></tr></table>"
HKBU = '{"items": [{"Title": "Lecturer, Department of Music", "Id": 5, "PostedEndDate": "2026-03-01", "ShortDescription": "Teach."}, {"title": "Tutor", "description": "It sits under the School of Business at our campus."}, {"Title": "Tutor"}], "hasMore": false}'
CUHK = "<table><tr><td>250001</td><td><a href='/c/1'>Assistant Professor</a></td><td>Department of History</td></tr><tr><td>250001</td><td><a href='/c/2'>Other one</a></td><td>x</td></tr></table>"
HKMU = "<table><tr><th scope='row'><a href='/j?job=26000BV&x=1'>Project Officer</a></th><td>1</td><td>Registry</td><td>12/Mar/2026</td></tr><tr><th>Head</th></tr></table>"
HSU = "<a href='https://recruit.hsu.edu.hk/opening/content.php?id=9'>Department of Art - Lecturer</a><a href='https://recruit.hsu.edu.hk/opening/content.php?id=10'>Tutor</a>"
SFU = "<div class='accordion-wrap'><a class='accordion-btn'>Dean, School of Health (Ref.: 25/1/SH)</a><div class='accordion-content'><p>The dean leads the school with care.</p><p>Deadline</p>\n<p>5 March 2026</p><li>Short</li></div></div>"
HKSYU = "<table><tr><th>Department / Unit</th><th>Position</th><th>FT</th><th>Closing</th></tr><tr><td>Registry</td><td><a href='/files/ro-1.pdf'>Research Officer</a></td><td>FT</td><td>05/03/2026 or until filled</td></tr><tr><td>Law</td><td>Part-time Tutor</td><td>PT</td><td>-</td></tr></table>"

#: source: html, body_text, wanted (id, title, rank, department, deadline, type).
CASES = {
    "polyu": (POLYU, "", [("POLYU-260213012", "Professor", "Professor", "Department of Music", "2026-02-27", "Full-time"), ("POLYU-260213013", "Dean", "Senior Management", "Law", "", "Full-time")]),
    "eduhk": (EDUHK_HTML, EDUHK, [("EDUHK-250001", "Lecturer in Physics", "Lecturer", "", "2026-02-05", "Full-time"), (None, "Senior Tutor", "Other", "", "N", "Full-time")]),
    "lingnan": (LINGNAN, "", [("LU-77", "Senior HR Officer", "Non-Academic", "Human Resources Office", "", "Full-time"), ("LU-79", "Dean of Arts", "Senior Management", "Lingnan University", "", "Full-time")]),
    "hku": (HKU, "", [("HKU-529001", "Lecturer in Law", "Lecturer", "Faculty of Law", "2026-03-04", "Full-time")]),
    "hkust": (HKUST_HTML, HKUST, [("HKUST-101", "Lecturer in Maths", "Lecturer", "Department of Mathematics", "2026-03-01", "Full-time"), ("HKUST-102", "Research Fellow", "Postdoctoral", "", "", "Full-time")]),
    "cityu": (CITYU, "", [("CITYU-A-1", "Professor", "Professor", "Dept of Physics", "until filled", "Full-time"), (None, "Dean of Law", "Senior Management", "Law", "", "Full-time"), (None, "Dean of Law", "Senior Management", "Law", "", "Full-time")]),
    "hkbu": ("", HKBU, [("HKBU-5", "Lecturer", "Lecturer", "Department of Music", "2026-03-01", "Full-time"), ("HKBU-Tutor", "Tutor", "Other", "School of Business", "", "Full-time")]),
    "cuhk": (CUHK, "", [("CUHK-250001", "Assistant Professor", "Assistant Professor", "Department of History", "", "Full-time")]),
    "hkmu": (HKMU, "", [("HKMU-26000BV", "Project Officer", "Non-Academic", "Registry", "2026-03-12", "Full-time")]),
    "hsu": (HSU, "", [("HSU-9", "Lecturer", "Lecturer", "Department of Art", "", "Full-time"), ("HSU-10", "Tutor", "Other", "Hang Seng University of Hong Kong", "", "Full-time")]),
    "sfu": (SFU, "", [(None, "Dean", "Senior Management", "School of Health", "2026-03-05", "Full-time")]),
    "hksyu": (HKSYU, "", [("HKSYU-ro-1", "Research Officer", "Research Assistant/Associate", "Registry", "2026-03-05", "Full-time"), (None, "Part-time Tutor", "Other", "Law", "", "Part-time")]),
}


def frame(spark, names=CASES):
    return spark.createDataFrame([(n, "s", 0, 0, f"https://list/{n}", CASES[n][0], CASES[n][1]) for n in names], "source string, section string, section_no long, page_no long, url string, html string, body_text string")


@pytest.mark.parametrize("name", CASES)
def test_site(spark, name):
    df = frame(spark, [name])
    got = S.SITES[name](df).orderBy("section_no", "page_no", "row_no").collect()
    want = CASES[name][2]
    assert len(got) == len(want)
    for r, (i, title, rank, dept, deadline, kind) in zip(got, want):
        assert (r.title, r.rank, r.deadline, r.position_type) == (title, rank, deadline, kind)
        assert i is None or r.id == i
        assert name == "eduhk" or r.department == dept


def test_collect_and_one_source(spark):
    out, errors = S.collect(frame(spark))
    assert not errors and out.count() == sum(len(c[2]) for c in CASES.values())
    # Two posts without a reference share a title, and two on one page its only reference.
    assert R.keep_first(out, ["id"], ["ingest_seq"]).count() == out.count() - 2
    one, _ = S.collect(frame(spark), "HKU")
    assert [r.university for r in one.collect()] == ["HKU"]
    with pytest.raises(ValueError):
        S.collect(frame(spark), "nowhere")


def test_override_and_details(spark):
    rows = {r.reference: (r.apply_url, r.url_changed) for r in S.hkust(frame(spark, ["hkust"])).collect()}
    assert rows["101"] == ("https://apply.interfolio.com/9", True) and "JobOpeningId=102" in rows["102"][0]
    page = "<nav>menu</nav><div class='ITS_Content_RichTextEditor'><p>One</p><p>ONE</p><p>Two</p></div>"
    df = spark.createDataFrame([("u", page, "x" * 70 + "\nClosing Date: March 5, 2026\n" + "y" * 70), ("v", f"<div>{'z ' * 100}</div>", "cloudflare " * 9)], "url string, html string, body_text string")
    assert [r.description for r in S.detail_blocks(df, "polyu").orderBy("url").collect()] == ["One\n\nTwo", ("z " * 100).strip()]
    assert [r[0] for r in df.orderBy("url").select(S.detail_text("cuhk")).collect()][0] == "x" * 70
    assert [r[0] for r in df.orderBy("url").select(S.detail_text("hku")).collect()][1] == ""
    posts = spark.createDataFrame([("u", ""), ("w", "")], "apply_url string, deadline string")
    assert {r.apply_url: r.deadline for r in S.closing_dates(posts, df, "cuhk").collect()} == {"u": "2026-03-05", "w": ""}


def test_html():
    assert H.body_text("<head><title>t</title></head><p>a<p>b <b>c</b><script>x='</p>'</script><br>d") == "a\nb c\nd"
    assert [r["cells"][0]["text"] for r in H.table_rows("<table><tr><td>1<tr><td>2</table>")] == ["1", "2"]
    assert H.next_link("<a title='Next' class='off' href='?p=2'>x</a>") == "?p=2" and H.next_link("<button>Next</button>") == ""
    assert H.next_link("<a title='Next' class='disabled'>x</a>") is None and H.next_link("<button disabled>next</button>") is None and H.next_link("") is None


def test_paging_and_source(spark):
    site = {"p1": "<a title='Next'>n</a>", "p2": "end", "n1": "<button>1</button><button>2</button>", "n2": "<button>2</button>", "o0": '{"items": [1], "hasMore": true}', "o25": '{"items": [], "hasMore": true}', "g1": "a", "g2": "aa", "g3": "aa", "one": "x"}
    read = lambda **k: [n for n, _, _ in pages(Start("s", "", **k), site.__getitem__)]
    assert read(url="p{page}", paging="next") == [0, 1] and read(url="n{page}", paging="numbered") == [0, 1]
    assert read(url="o{offset}", paging="offset") == [0, 1] and read(url="g{page}", paging="grow") == [1] and read(url="one") == [0]
    grown = {f"s{n}": "x" * min(n, 4) if n != 6 else "x" for n in range(1, 20)} | {f"r{n}": "<tr>" * n for n in (1, 2, 3)} | {"r4": "<tr>" * 3 + "longer"}
    assert [n for n, _, _ in pages(Start("s", "", "s{page}", paging="grow", patience=3), grown.__getitem__)] == [3]
    assert [t for _, _, t in pages(Start("s", "", "r{page}", paging="grow", rows="<tr"), grown.__getitem__)] == ["<tr>" * 3]
    chain = {"http://h/a": "Ad <a title='Next' href='/b'>n</a>", "http://h/b": "Ad <a title='Next' href='c'>n</a>", "http://h/c": "none <a title='Next' href='c'>n</a>"}
    assert [u for _, u, _ in pages(Start("s", "", "http://h/a", paging="next", anchor="Ad"), chain.__getitem__)] == ["http://h/a", "http://h/b"]
    endless = lambda url: '{"items": [1], "hasMore": true}'
    assert [n * 25 for n, _, _ in pages(Start("s", "", "o{offset}", paging="offset", most=100), endless)][-1] == 1000
    df = read_pages(spark, [Start("a", "", "one"), Start("b", "", "none")], site.__getitem__, pause=0)
    got = {r.source: (r.body_text, r.error) for r in df.collect()}
    assert got["a"] == ("x", None) and got["b"][0] is None and "KeyError" in got["b"][1]
    assert with_fallback(df, lambda: df.limit(1)).count() == 3


def test_fallback(spark):
    page = "<a href='https://x/job/12'>Lecturer, Music</a><a href='https://x/job/13'>Tutor</a>"
    df = spark.createDataFrame([(0, 0, "u", page)], "section_no long, page_no long, url string, html string")
    got = sorted((r.id, r.title, r.department) for r in S.hkbu_fallback(df).collect())
    assert got == [("HKBU-12", "Lecturer", "Music"), ("HKBU-13", "Tutor", "Hong Kong Baptist University")]
