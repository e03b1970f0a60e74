"""One transform for each source: archived pages in, postings out.

Pages have source, section, section_no, page_no, url, html and body_text. HTML is parsed
into arrays once; all recognition is DataFrame expressions. Each transform keeps the
first posting of the source's own key, in the order of sections, pages and rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import rules
from postlake.functions import text as T
from postlake.operators import reconcile as R
from postlake.operators.metrics import Counted

from . import html as H

_ORDER = ["section_no", "page_no", "row_no"]
_NAMES = {s: (code, prefix, full) for s, code, prefix, full in rules.UNIVERSITIES}

BASES = rules.BASES
#: The section of pages that a browser rendered, where a source has another way too.
RENDERED = "rendered"


def _finish(df: DataFrame, source: str, id_ref: Column, override: Column | None = None) -> DataFrame:
    """The posting columns, from title, dept, deadline, ref, apply_url and description."""
    code, prefix, full = _NAMES[source]
    t = F.col("title")
    return df.select(
        T.make_id(prefix, id_ref).alias("id"), "title", T.detect_rank(t).alias("rank"), F.lit(code).alias("university"), F.lit(full).alias("university_full"),
        F.col("dept").alias("department"), "deadline", F.col("ref").alias("reference"), T.position_type(t, override).alias("position_type"), F.lit("").alias("salary"),
        F.lit("").alias("start_date"), "apply_url", "description", *_ORDER,
    )


def _ref_or_title(n: int = 25) -> Column:
    return T.first_filled(F.col("ref"), F.left("title", F.lit(n)))


def _first(df: DataFrame, key: Column, blank_stays: bool = False, scope: list[str] | None = None) -> DataFrame:
    """The first row of each key; with blank_stays, rows with an empty one all stay."""
    order = F.struct(*_ORDER)
    key = F.when(key == "", F.concat(F.lit("\0"), order.cast("string"))).otherwise(key) if blank_stays else key
    return R.keep_first(df.withColumn("__key", key), [*(scope or []), "__key"], _ORDER).drop("__key")


def _listed(pages: DataFrame, column: str) -> DataFrame:
    """Of a page only what is parsed and where it stands."""
    return pages.select("section_no", "page_no", "url", column)


def _cells(pages: DataFrame) -> DataFrame:
    """A row for each table row, with cells' texts as an array."""
    rows = H.with_parsed(_listed(pages, "html"), "html", "rows", "rows", H.table_rows).select("section_no", "page_no", "url", F.posexplode("rows").alias("row_no", "r"))
    return rows.select(*_ORDER, "url", F.col("r.table_no").alias("table_no"), F.col("r.row_no").alias("in_table"), F.col("r.cells").alias("cells"), F.col("r.href").alias("href"), F.col("r.link_text").alias("link_text"))


def _links(pages: DataFrame) -> DataFrame:
    rows = H.with_parsed(_listed(pages, "html"), "html", "links", "links", H.links).select("section_no", "page_no", "url", F.posexplode("links").alias("row_no", "l"))
    return rows.select(*_ORDER, "url", F.col("l.href").alias("href"), F.col("l.text").alias("full_title"), F.col("l.card").alias("card"))


def _texts(cells: Column) -> Column:
    return F.transform(cells, lambda c: c["text"])


def _full(source: str) -> Column:
    return F.lit(_NAMES[source][2])


def _or_name(dept: Column, source: str) -> Column:
    return T.first_filled(dept, _full(source))


def project_cell(cells: Column, ref: Column) -> Column:
    """The third of five cells or more, a project's title, unless it is the reference or has four digits in a row."""
    third = F.get(cells, 2)
    return F.when((F.size(cells) >= 5) & (third != ref) & ~third.rlike(r"\d{4}"), third).otherwise("")


def polyu(pages: DataFrame) -> DataFrame:
    rows = _cells(pages).where("table_no = 0 and in_table > 0")
    rows = rows.withColumn("td", F.filter("cells", lambda c: c["tag"] == "td")).withColumn("t", _texts(F.col("td"))).where(F.size("t") >= 3)
    t = F.col("t")
    bare = F.transform(t, lambda x: F.replace(x, F.lit(" "), F.lit("")))
    rows = rows.withColumn("ref", T.first_match(bare, rules.LONG_NUMBER)).withColumns({"dept": F.get(t, 0), "title": F.get(t, 1), "deadline": F.coalesce(F.get(T.date_cells(t), 0), F.lit(""))})
    project = project_cell(t, F.col("ref"))
    about = F.concat("title", F.when(project != "", F.concat(F.lit(" — Project: "), project)).otherwise(""), F.lit(" ("), F.col("dept"), F.lit("). See application link for full details."))
    rows = _first(rows.where("ref <> '' and title <> ''").withColumn("description", about), F.col("ref"))
    return _finish(rows.withColumn("apply_url", F.concat(F.lit(f"{BASES['polyu']}/job_detail.php?job="), "ref")), "polyu", F.col("ref"), F.lit("Full-time"))


def eduhk(pages: DataFrame) -> DataFrame:
    found = H.with_parsed(_listed(pages, "body_text"), "body_text", "w", "windows", lambda t: H.windows(t, rules.AD_LABEL, 600, 200)).select("section_no", "page_no", "url", F.posexplode("w").alias("row_no", "w"))
    usable = F.filter(T.lines(F.col("w.before")), lambda x: ~x.rlike(rules.NAV_LINE) & ~F.startswith(x, F.lit("Ref:")) & (F.length(x) > 2) & ~F.lower(x).isin(*rules.NOISE_LINES))
    rows = found.withColumn("l", F.reverse(usable))
    is_dept = lambda x: x.rlike(rules.DEPT_LINE)
    title = F.coalesce(F.get(F.filter("l", lambda x: ~is_dept(x)), 0), F.lit(""))
    at = F.when(title != "", F.array_position("l", title) - 1).otherwise(F.size("l"))
    dept = F.coalesce(F.get(F.filter(F.slice("l", F.lit(1), at.cast("int")), is_dept), 0), F.lit(""))
    rows = rows.withColumns({"t0": title, "d0": dept}).withColumns({"title": T.first_filled(F.col("t0"), F.col("d0")), "dept0": F.when(F.col("t0") != "", F.col("d0")).otherwise("")}).where(F.length("title") >= 3)
    near = F.concat(F.right(F.col("w.before"), F.lit(150)), F.left(F.col("w.after"), F.lit(50)))
    raw = T.strip(F.regexp_extract("w.after", rules.AD_CLOSE, 1))
    rows = rows.withColumns({"ref": F.regexp_extract(near, rules.AD_REF, 1), "deadline": F.when(F.upper(raw).isin("N/A", "NA", ""), "").otherwise(T.parse_date(raw))})
    key = F.concat_ws("|", "title", T.first_filled(F.col("ref"), F.col("dept0")))
    rows = _first(rows.drop("w", "l"), key)
    pdf = _links(pages).where(F.contains("href", F.lit("/cms/f/career"))).select("section_no", "page_no", "row_no", T.resolved_url(F.col("href"), F.col("url")).alias("href"))
    rows = R.zip_by_ordinal(rows, pdf, ["section_no", "page_no"], ["row_no"], "row_no", F.col("url"))
    rows = rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept0"), "See EdUHK website for full details.", optional=True))
    rows = rows.withColumn("dept", T.first_filled(F.col("dept0"), T.infer_department(F.col("title")), _full("eduhk")))
    return _finish(rows, "eduhk", T.first_filled(F.col("ref"), F.concat(F.left("title", F.lit(40)), F.lit("_"), F.left("dept0", F.lit(20)))))


def lingnan(pages: DataFrame) -> DataFrame:
    rows = _first(_links(pages).where(F.col("href").rlike("(?i)requisition") & (F.length("full_title") >= 5)), F.col("full_title"))
    title, dept = T.last_comma(F.col("full_title"))
    rows = rows.withColumns({"title": title, "dept": F.when(F.contains("full_title", F.lit(",")), dept).otherwise(_full("lingnan")), "ref": F.regexp_extract("href", r"requisition/(\d+)", 1), "deadline": F.lit(""), "apply_url": T.absolute_url(F.col("href"), BASES["lingnan"])})
    return _finish(rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept"))), "lingnan", _ref_or_title())


def hku(pages: DataFrame) -> DataFrame:
    rows = _cells(pages).where(F.col("href").isNotNull() & (F.length("link_text") >= 5)).withColumn("title", F.col("link_text"))
    t = _texts(F.filter("cells", lambda c: c["tag"] == "td"))
    rows = rows.withColumn("t", t)
    number = lambda x: x.rlike(rules.SHORT_NUMBER)
    is_dept = lambda x: x.rlike(rules.DEPT_CELL) & (x != F.col("title"))
    depts = F.filter("t", lambda x: ~number(x) & is_dept(x))
    dates = T.date_cells(F.filter("t", lambda x: ~number(x) & ~is_dept(x)))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
    rows = rows.withColumns({"ref": T.last_match(F.col("t"), rules.SHORT_NUMBER), "dept": _or_name(last(depts), "hku"), "deadline": last(dates), "apply_url": T.absolute_url(F.col("href"), BASES["hku"])})
    # A title that is left out still takes its key: dedup comes first.
    rows = _first(rows.drop("cells", "t"), T.first_filled(F.col("ref"), F.concat_ws("|", "title", "dept"))).where(~T.contains_any(F.lower("title"), rules.ADMIN_TITLES))
    return _finish(rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept"))), "hku", _ref_or_title())


def hkust(pages: DataFrame) -> DataFrame:
    found = H.with_parsed(_listed(pages, "body_text"), "body_text", "w", "windows", lambda t: H.windows(t, rules.JOB_LABEL, 300, 300)).select("section_no", "page_no", "url", F.posexplode("w").alias("row_no", "w"))
    rows = _first(found.withColumn("ref", F.col("w.value")), F.col("ref"), scope=["section_no", "page_no"])
    above = F.filter(F.reverse(T.lines(F.col("w.before"))), lambda x: ~x.rlike(rules.LABEL_LINE) & (F.length(x) > 4))
    below = T.lines(F.col("w.after"))
    stop = lambda x: x.rlike(rules.JOB_STOP)
    rows = rows.withColumn("below", below).withColumn("n", F.coalesce(F.array_position(F.transform("below", stop), True) - 1, F.lit(-1)))
    until = F.slice("below", F.lit(1), F.when(F.col("n") >= 0, F.col("n")).otherwise(F.size("below")).cast("int"))
    rows = rows.withColumns({
        "title": T.clean(F.coalesce(F.get(above, 0), F.lit(""))), "dept": F.coalesce(F.get(F.filter(until, lambda x: F.length(x) > 4), 0), F.lit("")),
        "deadline": T.parse_date(F.regexp_extract("w.after", rules.JOB_CLOSE, 1)), "apply_url": F.replace(F.lit(BASES["hkust"]), F.lit("{ref}"), F.col("ref")),
    }).where(F.length("title") >= 4).drop("w", "below", "n")
    urls = H.with_parsed(pages.select("html"), "html", "u", "urls", lambda h: H.nearest_links(h, "Job ID", "interfolio")).select(F.explode("u").alias("u")).select("u.*")
    done = _finish(rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept"), optional=True)), "hkust", F.col("ref"))
    return R.override_urls(done, urls)


def cityu(pages: DataFrame) -> DataFrame:
    rows = _cells(pages).withColumn("td", F.filter("cells", lambda c: c["tag"] == "td")).where(F.size("td") >= 2)
    one, two, three = (F.get("td", i) for i in range(3))
    rows = rows.withColumns({"title": one["link_text"], "href": one["href"], "dept": two["text"], "deadline": T.parse_date(F.coalesce(three["text"], F.lit("")))}).where(F.col("href").isNotNull() & (F.length("title") >= 3))
    rows = rows.withColumns({"ref": F.regexp_extract("href", r"(?i)ref=([\w\-]+)", 1), "apply_url": T.prefixed_url(F.col("href"), BASES["cityu"])})
    rows = _first(rows.drop("cells", "td"), F.col("ref"), blank_stays=True)
    return _finish(rows.withColumn("description", F.lit("")), "cityu", _ref_or_title())


def _hkbu_fields(rows: DataFrame) -> DataFrame:
    title, right = T.last_comma(F.col("full_title"))
    return rows.withColumns({"title": title, "dept": F.when(F.contains("full_title", F.lit(",")), right).otherwise(T.infer_department(F.col("full_title")))})


def hkbu(pages: DataFrame) -> DataFrame:
    """From JSON pages, whose text is in body_text."""
    rows = pages.withColumn("body", F.col("body_text")).select("section_no", "page_no", F.posexplode(F.from_json("body", "items array<string>")["items"]).alias("row_no", "j"))
    j = F.col("j")
    rows = rows.withColumns({
        "full_title": T.clean(T.json_first(j, "Title", "title", "JobTitle", "displayTitle")), "ref": T.json_first(j, "Id", "id", "RequisitionNumber", "requisitionNumber", "ExternalReqNumber"),
        "deadline": T.parse_date(T.json_first(j, "PostedEndDate", "postedEndDate", "ClosingDate", "closingDate")), "about": T.clean(T.json_first(j, "ExternalDescriptionStr", "ShortDescription", "description")),
    }).where("full_title <> ''")
    rows = _hkbu_fields(_first(rows.drop("j"), F.col("full_title")))
    under = T.strip(F.regexp_extract("about", rules.SITS_UNDER, 1))
    rows = rows.withColumn("dept", T.first_filled(F.col("dept"), under, _full("hkbu")))
    rows = rows.withColumn("apply_url", F.when(F.col("ref") != "", F.concat(F.lit(f"{BASES['hkbu']}/"), "ref")).otherwise(F.lit(f"{BASES['hkbu']}s")))
    return _finish(rows.withColumn("description", F.when(F.col("about") != "", F.left("about", F.lit(rules.LONGEST))).otherwise(T.placeholder(F.col("title"), F.col("dept")))), "hkbu", _ref_or_title())


def hkbu_fallback(pages: DataFrame) -> DataFrame:
    """From rendered pages, where the JSON source failed; rows it gave before stay, and overlap is left to dedup."""
    rows = _first(_links(pages).where(F.contains("href", F.lit("/job/")) & (F.col("full_title") != "")), F.col("full_title"))
    rows = _hkbu_fields(rows).withColumns({"ref": F.regexp_extract("href", r"/job/(\d+)", 1), "deadline": F.lit(""), "apply_url": T.resolved_url(F.col("href"), F.col("url"))})
    rows = rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept"), optional=True)).withColumn("dept", _or_name(F.col("dept"), "hkbu"))
    return _finish(rows, "hkbu", _ref_or_title())


def hkbu_composed(pages: DataFrame) -> DataFrame:
    """The JSON source and, if one of its pages failed, what the rendered pages have after it.

    Pages of the section RENDERED are the fallback's; error tells which of the others
    failed. What the JSON pages gave before stays, and postings that both have are left to
    dedup, where the JSON source's come first.
    """
    rendered, failed = F.col("section") == RENDERED, F.col("error").isNotNull()
    any_failed = pages.where(~rendered & failed).agg((F.count("*") > 0).alias("failed")).scalar()
    return hkbu(pages.where(~rendered & ~failed)).unionByName(hkbu_fallback(pages.where(rendered & any_failed)))


def cuhk(pages: DataFrame) -> DataFrame:
    rows = _cells(pages).withColumn("td", F.filter("cells", lambda c: c["tag"] == "td")).where(F.size("td") >= 3)
    linked = F.coalesce(F.array_position(F.transform("td", lambda c: F.coalesce(c["link_text"], F.lit("")) != ""), True), F.lit(0))
    rows = rows.withColumn("at", linked.cast("int")).where("at > 0")
    title = F.get("td", F.col("at") - 1)
    after = F.filter(F.slice("td", F.col("at") + 1, F.size("td")), lambda c: c["href"].isNull() & (F.length(c["text"]) > 5) & ~c["text"].rlike(r"^\d+$"))
    rows = rows.withColumns({"title": title["link_text"], "apply_url": T.first_filled(T.absolute_url(title["href"], BASES["cuhk"]), F.col("url")), "ref": T.first_match(_texts(F.col("td")), rules.SHORT_NUMBER), "dept0": F.coalesce(F.get(after, 0)["text"], F.lit(""))})
    rows = rows.where(F.length("title") >= 5).withColumn("key", T.first_filled(F.col("ref"), F.concat_ws("|", "title", "dept0")))
    rows = _first(rows.drop("cells", "td", "at"), F.col("key")).withColumns({"dept": _or_name(F.col("dept0"), "cuhk"), "deadline": F.lit("")})
    return _finish(rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept"))), "cuhk", T.first_filled(F.col("ref"), F.concat_ws("|", "title", "dept")))


def hksyu(pages: DataFrame) -> DataFrame:
    rows = _cells(pages).where("table_no >= 0").withColumn("t", _texts(F.col("cells"))).where(F.size("t") >= 4)
    rows = rows.withColumns({"dept0": F.get("t", 0), "title": F.get("t", 1), "closing": F.get("t", 3), "apply_url": F.coalesce(T.absolute_url(F.col("href"), BASES["hksyu"]), F.col("url"))})
    rows = rows.where((F.col("dept0") != "Department / Unit") & (F.length("title") >= 3) & F.col("title").rlike("[A-Za-z]"))
    rows = rows.withColumns({"ref": F.regexp_extract("apply_url", r"/([^/]+)\.pdf", 1), "deadline": T.parse_date(F.regexp_extract("closing", r"\d{1,2}/\d{1,2}/\d{4}", 0))})
    rows = _first(rows.drop("cells", "t"), T.first_filled(F.col("ref"), F.concat_ws("|", "dept0", "title")))
    rows = rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept0"))).withColumn("dept", _or_name(F.col("dept0"), "hksyu"))
    return _finish(rows, "hksyu", _ref_or_title())


def sfu(pages: DataFrame) -> DataFrame:
    rows = H.with_parsed(_listed(pages, "html"), "html", "b", "accordions", H.accordions).select("section_no", "page_no", "url", F.posexplode("b").alias("row_no", "b")).select(*_ORDER, "url", "b.*")
    ref, bare = T.inline_reference(F.col("button"))
    rows = _first(rows.withColumns({"ref": ref, "bare": bare}), T.first_filled(F.col("ref"), F.col("button")))
    title, dept = T.last_comma_department(F.col("bare"))
    rows = rows.withColumns({"title": title, "dept0": dept, "deadline": T.parse_date(F.regexp_extract("body", rules.ACCORDION_CLOSE, 1))})
    rows = rows.withColumns({"apply_url": F.col("url"), "dept": _or_name(F.col("dept0"), "sfu"), "description": T.first_filled(T.content_paragraphs(F.col("parts")), T.placeholder(F.col("title"), F.col("dept0"), optional=True))})
    return _finish(rows, "sfu", _ref_or_title())


def hsu(pages: DataFrame) -> DataFrame:
    rows = _links(pages).where(F.contains("href", F.lit("recruit.hsu.edu.hk/opening/content.php")) & (F.col("full_title") != ""))
    rows = _first(rows.withColumns({"ref": F.regexp_extract("href", r"id=(\d+)", 1), "apply_url": F.col("href")}), F.col("ref"), blank_stays=True)
    dept, title = T.first_dash(F.col("full_title"))
    rows = rows.withColumns({"title": title, "dept0": dept, "deadline": F.lit("")}).withColumns({"dept": _or_name(F.col("dept0"), "hsu"), "description": T.placeholder(F.col("title"), F.col("dept0"))})
    return _finish(rows, "hsu", _ref_or_title())


def hkmu(pages: DataFrame) -> DataFrame:
    rows = _cells(pages).where("table_no = 0").withColumn("th", F.get(F.filter("cells", lambda c: (c["tag"] == "th") & (c["scope"] == "row")), 0))
    rows = rows.where(F.col("th.href").isNotNull() & (F.length("th.link_text") >= 5)).withColumn("td", F.filter("cells", lambda c: c["tag"] == "td"))
    at = lambda i: F.coalesce(F.get("td", i)["text"], F.lit(""))
    rows = rows.withColumns({"title": F.col("th.link_text"), "ref": F.regexp_extract("th.href", r"[?&]job=([^&]+)", 1), "apply_url": T.first_filled(T.absolute_url(F.col("th.href"), BASES["hkmu"]), F.col("url")), "dept": _or_name(at(1), "hkmu"), "deadline": T.parse_date(at(2))})
    rows = _first(rows.drop("cells", "td", "th"), T.first_filled(F.col("ref"), F.col("title")))
    return _finish(rows.withColumn("description", T.placeholder(F.col("title"), F.col("dept"))), "hkmu", _ref_or_title())


# --- Detail pages -----------------------------------------------------------------------

def detail_text(source: str) -> Column:
    """The description in a detail page's body_text, for sources that read lines; empty on a protected page."""
    body = T.text("body_text")
    if source == "cuhk":
        cut = F.instr(body, "Closing Date")
        return T.substantive(F.when(cut > 1, F.left(body, cut - 1)).otherwise(body), 15)
    if source == "hku":
        return F.when(T.contains_any(F.lower(body), rules.BOT_MARKERS), "").otherwise(T.substantive(body))
    return T.substantive(body)


def detail_blocks(details: DataFrame, source: str) -> DataFrame:
    """url, description and whole (the page's text) of detail pages, for sources whose page has a content element or a longest block."""
    tags = {"polyu": ("div", "td", "section"), "cityu": ("div", "td", "section", "article"), "hsu": ("div", "section", "article", "main")}[source]
    out = H.with_parsed(details.select("url", "html"), "html", "d", "detail", lambda h: H.detail(h, rules.CONTENT_CLASS, *tags))
    longest = T.longest_block(F.col("d.blocks"), 2000 if source == "polyu" else rules.LONGEST)
    if source == "polyu":
        longest = T.first_filled(T.distinct_paragraphs(F.col("d.parts")), longest)
    return out.select("url", longest.alias("description"), F.col("d.whole").alias("whole"))


def closing_date(body: Column, source: str) -> Column:
    """The closing date that a detail page's text names; empty without one."""
    return T.parse_date(F.regexp_extract(body, rules.CLOSING[source], 1))


def closing_dates(postings: DataFrame, details: DataFrame, source: str) -> DataFrame:
    """deadline from the detail page for postings that have none."""
    found = R.unique(details.select("url", closing_date(T.text("body_text"), source).alias("d")), "url", "d").select(F.col("url").alias("__u"), F.col("d").alias("__d"))
    out = postings.join(found, F.col("apply_url") == F.col("__u"), "left")
    return out.withColumn("deadline", T.first_filled(F.col("deadline"), F.col("__d"))).drop("__u", "__d")


def _detailed(postings: DataFrame, found: DataFrame, due: Column) -> DataFrame:
    """description from found(url, description) where the posting is due and there is one; its own otherwise."""
    one = R.unique(found, "url", "description").select(F.col("url").alias("__u"), F.col("description").alias("__x"))
    out = postings.withColumn("__due", due).join(one, F.col("apply_url") == F.col("__u"), "left")
    return out.withColumn("description", F.when(F.col("__due"), T.first_filled(F.col("__x"), F.col("description"))).otherwise(F.col("description"))).drop("__u", "__x", "__due")


def with_detail_error(postings: DataFrame, details: DataFrame) -> DataFrame:
    """postings with detail_error: why a posting has nothing from its detail page, null where it has a page with text.

    `not archived` where there is no page, the page's own error (details may have the
    column) where fetching failed, `empty` where it came without text. A page that is there
    more than once counts as read if one of them was.
    """
    error = F.col("error") if "error" in details.columns else F.lit(None).cast("string")
    blank = T.first_filled(F.col("html"), F.col("body_text")) == ""
    seen = details.select(F.col("url").alias("__u"), F.when(error.isNotNull(), error).when(blank, "empty").alias("__e"))
    one = seen.where("__u is not null").groupBy("__u").agg(F.bool_or(F.col("__e").isNull()).alias("__read"), F.max("__e").alias("__e"))
    out = postings.join(one, F.col("apply_url") == F.col("__u"), "left")
    why = F.when(F.col("__u").isNull(), "not archived").when(~F.col("__read"), F.col("__e"))
    return out.withColumn("detail_error", why).drop("__u", "__e", "__read")


def _good(postings: DataFrame, cache: DataFrame) -> DataFrame:
    """postings with __cached: the good description of an earlier run, or null."""
    good = R.unique(cache.where(R.good_cached(F.col("description"))), "id", "description")
    return postings.join(good.select(F.col("id").alias("__id"), F.col("description").alias("__cached")), F.col("id") == F.col("__id"), "left").drop("__id")


def run_source(source: str, pages: DataFrame, details: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """A source's whole run: its list, then what its detail pages add.

    details: url, html, body_text of detail pages, each read once however often it was
    archived; a posting without one keeps what it has. cache: id, description of the last
    run. Which postings read a detail page, and what they take from it, differs by source.
    """
    out = (hkbu_composed if source == "hkbu" and "error" in pages.columns else SITES[source])(pages)
    retained = T.is_retained(F.col("deadline"), as_of)
    texts = lambda: details.select("url", detail_text(source).alias("description"))
    if source == "polyu":
        return _detailed(out.where(retained), detail_blocks(details, source).drop("whole"), F.lit(True))
    if source == "cityu":
        # What closed too long ago stays without a description.
        out = out.withColumn("description", F.when(retained, T.placeholder(F.col("title"), F.col("department"))).otherwise(""))
        return _detailed(out, detail_blocks(details, source).drop("whole"), retained)
    if source in ("lingnan", "hku", "hkmu"):
        due = F.col("__cached").isNull() & (F.lit(True) if source == "lingnan" else retained)
        out = _detailed(_good(out, cache), texts(), due)
        return out.withColumn("description", F.coalesce("__cached", "description")).drop("__cached")
    if source == "hkust":
        # A changed URL makes the cached description void; it is not put back for the others.
        due = retained & F.contains("apply_url", F.lit("interfolio")) & (F.col("__cached").isNull() | F.col("url_changed"))
        return _detailed(_good(out, cache), texts(), due).drop("__cached", "url_changed")
    if source == "hkbu":
        return closing_dates(out, details, source)
    if source == "cuhk":
        out = out.withColumn("__open", (F.col("deadline") == "") & (F.col("apply_url") != ""))
        return _detailed(closing_dates(out, details, source), texts(), F.col("__open")).drop("__open")
    if source == "hsu":
        found = detail_blocks(details, source)
        out = _detailed(out, found.drop("whole"), F.lit(True))
        return closing_dates(out, found.select("url", F.col("whole").alias("body_text")), source)
    return out


#: Every source's transform, in the registry's order.
SITES = {"polyu": polyu, "eduhk": eduhk, "lingnan": lingnan, "hku": hku, "hkust": hkust, "cityu": cityu, "hkbu": hkbu, "cuhk": cuhk, "hkmu": hkmu, "hsu": hsu, "sfu": sfu, "hksyu": hksyu}


def run_all(pages: DataFrame, details: DataFrame, cache: DataFrame, previous: DataFrame, as_of: Column, counted: dict[str, Counted] | None = None, summariser=None) -> DataFrame:
    """The whole of a day: every source's list and detail pages, one after the other in the registry's order, to the next snapshot.

    pages and details have a source each; where they are archived by source, each source's
    files are opened once for its list. previous is the last snapshot, cache its
    descriptions. Counts of `counted`, found before dedup and kept after, arrive as it runs.
    """
    parts = []
    for i, name in enumerate(SITES):
        out = run_source(name, pages.where(F.col("source") == name), details.where(F.col("source") == name).drop("source"), cache, as_of)
        parts.append(out.withColumn("ingest_seq", F.struct(F.lit(i).alias("source_no"), *_ORDER)).drop(*_ORDER))
    found, counted = R.union_sources(parts), counted or {}
    out = R.run(counted["found"].of(found) if "found" in counted else found, previous, as_of, summariser)
    return counted["kept"].of(out) if "kept" in counted else out


def archive(pages: DataFrame, folder: str) -> None:
    """Adds pages to the archive in folder, which has a folder for each source."""
    pages.write.mode("append").partitionBy("source").parquet(folder)


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's pages. What asks for one source, as collect does, opens this source's files alone."""
    return spark.read.parquet(folder)


def collect(pages: DataFrame, source: str | None = None, sites: dict | None = None, settle=None) -> tuple[DataFrame, dict[str, str]]:
    """All sources' postings in the registry's order with ingest_seq, and the errors of those that failed.

    With source, that one alone; an unknown name is a ValueError. settle(DataFrame) works
    a source out and keeps it, such as storage.kept: with it, a source that fails in its
    tasks is left out like one whose plan fails, and the others are not touched.
    """
    sites = sites or SITES
    if source is not None and source.lower() not in sites:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(sites)}")
    parts, errors = [], {}
    for i, (name, site) in enumerate(sites.items()):
        if source is None or source.lower() == name:
            try:
                part = site(pages.where(F.col("source") == name)).withColumn("ingest_seq", F.struct(F.lit(i).alias("source_no"), *_ORDER)).drop(*_ORDER)
                parts.append(settle(part) if settle else part)
            except Exception as e:  # noqa: BLE001  one source's failure leaves the others
                if source is not None:
                    raise
                errors[name] = str(e)
    return R.union_sources(parts), errors
