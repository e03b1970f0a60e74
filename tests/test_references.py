from postlake.sources import html as H


def test_references_without_a_semicolon_stay_where_only_ended_ones_count():
    page = "<article><h1>a&amp;&amp; b&amp</h1><p>&lt;x&gt; &#39;&ampfoo; &nosuch; &#169 c</p></article>"
    assert H.blocks(page, "article", ended=True) == ["a&& b&amp <x> '&ampfoo; &nosuch; &#169 c"]
    assert H.blocks(page, "article") == ["a&& b& <x> '&foo; &nosuch; © c"]
