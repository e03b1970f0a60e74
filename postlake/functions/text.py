"""Column expressions that normalise and classify posting fields.

All are built-in functions, so that they stay in generated code; none needs Python rows.
Missing text is the empty string, as in the posting table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_WS = r"(?U)[\s\x1c-\x1f]+"
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def clean(c: Column | str) -> Column:
    """Runs of white space, Unicode's too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text(c), _WS, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def make_id(prefix: Column | str, ref: Column) -> Column:
    """A short plain reference after the prefix, or ten digits of the MD5 of any other; `unknown` without one."""
    up = F.upper(F.lit(prefix) if isinstance(prefix, str) else prefix)
    key = F.when(text(ref) == "", F.lit("unknown")).otherwise(clean(ref))
    plain = (F.length(key) <= 20) & key.rlike(r"(?U)^[\w\-]+$")
    return F.concat(up, F.lit("-"), F.when(plain, key).otherwise(F.left(F.md5(key), F.lit(10))))


def detect_rank(title: Column, description: Column | None = None) -> Column:
    """The rank of the first rule that the title, or for open faculty posts the description, meets."""
    t = F.lower(text(title))
    d = F.lower(text(description)) if description is not None else F.lit("")
    has = lambda c, *words: reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))
    faculty = t.rlike(r"(?U)\bfaculty\b") & t.rlike(r"(?U)\bpositions?\b")
    rank = F.when(has(t, "tenure-track", "tenure track", "substantiation-track") & ~has(t, "non-tenure"), "Tenure-Track")
    rank = rank.when(faculty & has(d, "tenure-track", "tenure track") & ~has(d, "non-tenure"), "Tenure-Track")
    rank = rank.when(faculty & has(d, "lecturer"), "Lecturer")
    for phrase, name in rules.RANK_PHRASES:
        rank = rank.when(F.contains(t, F.lit(phrase)), name)
    return rank.when(t.rlike("|".join(rules.NON_ACADEMIC)), "Non-Academic").otherwise("Other")


def detect_type(title: Column) -> Column:
    t = F.lower(text(title))
    fixed = F.contains(t, F.lit("temporary")) | F.contains(t, F.lit("fixed-term"))
    return F.when(fixed, "Fixed-term").when(F.contains(t, F.lit("part-time")), "Part-time").otherwise("Full-time")


def position_type(title: Column, override: Column | None = None) -> Column:
    """The source's own type where it gives one."""
    return detect_type(title) if override is None else F.coalesce(F.nullif(override, F.lit("")), detect_type(title))


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use reads it, in filters too."""
    return F.get(F.transform(F.array(value), use), 0)


def parse_date(c: Column | str) -> Column:
    """The date as yyyy-MM-dd by the first pattern that fits the cleaned text, else that text."""

    def tried(t: Column) -> Column:
        shaped = t.rlike(r"^\d{1,4}[ /\-]\w{1,9}[ /\-]\d{1,4}$|^\w{3,9} \d{1,2}, \d{4}$")
        long, short, iso, day_first, month_first, slashed, us_long, us_short = (F.try_to_date(t, p) for p in rules.DATE_PATTERNS)
        # How a text begins tells which patterns can fit: a parser that fails is dear.
        read = F.when(t.rlike(r"^\d+ "), F.coalesce(long, short)).when(t.rlike(r"^\d+-"), iso).when(t.rlike(r"^\d+/\d+/"), F.coalesce(day_first, month_first)).when(t.rlike(r"^\d+/"), slashed).otherwise(F.coalesce(us_long, us_short))
        return F.when(shaped, F.coalesce(F.date_format(read, "yyyy-MM-dd"), t)).otherwise(t)

    return _bound(clean(c), tried)


def deadline_date(deadline: Column) -> Column:
    """The date of a parsed deadline; null for none and for free text."""
    return F.try_to_date(F.regexp_extract(deadline, r"^\d{4}-\d{1,2}-\d{1,2}$", 0), "yyyy-M-d")


def is_active(deadline: Column, as_of: Column) -> Column:
    """True from an unknown or unread deadline, or one not before as_of."""
    return F.coalesce(deadline_date(deadline) >= as_of, F.lit(True))


def is_retained(deadline: Column, as_of: Column, days: int = rules.RETENTION_DAYS) -> Column:
    return is_active(deadline, F.date_sub(as_of, days))


def infer_department(title: Column) -> Column:
    """`in X`, else `of X`, else `(X)` at the end; empty without any."""
    t = text(title)
    one = F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(t, rules.DEPT_IN, 1)), ",+$", ""), "/+$", "")
    two = strip(F.regexp_extract(t, rules.DEPT_OF, 1))
    three = strip(F.regexp_extract(t, rules.DEPT_TAIL, 1))
    fits = (F.length(one) > 5) & (F.length(one) < 80) & ~one.rlike(r"^\d")
    return F.when(fits, one).when(t.rlike(rules.DEPT_OF) & (F.length(two) < 70), two).when((three != "") & ~three.rlike(rules.NOT_DEPT), three).otherwise("")


def last_comma(t: Column) -> tuple[Column, Column]:
    """What stands before and after the last comma; all and nothing without one."""
    right = F.substring_index(t, ",", -1)
    left = F.left(t, F.length(t) - F.length(right) - 1)
    some = F.contains(t, F.lit(","))
    return F.when(some, strip(left)).otherwise(t), F.when(some, strip(right)).otherwise("")


def last_comma_department(t: Column) -> tuple[Column, Column]:
    """Splits at the last comma and space if a department's word stands after it."""
    right = F.substring_index(t, ", ", -1)
    some = F.contains(t, F.lit(", ")) & right.rlike(rules.DEPT_WORD)
    left = F.left(t, F.length(t) - F.length(right) - 2)
    return F.when(some, strip(left)).otherwise(t), F.when(some, strip(right)).otherwise("")


def first_dash(t: Column) -> tuple[Column, Column]:
    """Department and title around the first dash; a spaced en dash anywhere goes before a hyphen."""
    parts = F.when(F.contains(t, F.lit(" – ")), F.split(t, r"\Q – \E", 2)).otherwise(F.split(t, r"\Q - \E", 2))
    two = F.size(parts) > 1
    return F.when(two, strip(F.get(parts, 0))).otherwise(""), F.when(two, strip(F.get(parts, 1))).otherwise(t)


def inline_reference(t: Column) -> tuple[Column, Column]:
    """The reference in `(Ref.: X)`, and the title without any such bracket."""
    return strip(F.regexp_extract(t, r"Ref\.:\s*([^)]+)\)", 1)), strip(F.regexp_replace(t, r"(?U)\s*\(Ref\.[^)]*\)", ""))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).otherwise(href)


def resolved_url(href: Column, page: Column) -> Column:
    """The link as a browser on the page reads it: from the site's root, from the page's folder, or as it is."""
    origin, scheme = F.regexp_extract(page, r"^([A-Za-z][\w+.-]*://[^/?#]+)", 1), F.regexp_extract(page, r"^([A-Za-z][\w+.-]*:)", 1)
    folder = F.concat(origin, F.regexp_replace(F.regexp_extract(page, r"^[A-Za-z][\w+.-]*://[^/?#]+([^?#]*)", 1), r"[^/]*$", ""))
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    out = F.when(href.rlike(r"^[A-Za-z][\w+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
    return out.when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(F.concat(folder, href))


def prefixed_url(href: Column, base: str) -> Column:
    """The base before anything that is not already http."""
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base), href))


def json_first(body: Column, *keys: str) -> Column:
    """The first of the keys with a value that is neither missing nor empty; keys are told by case."""
    return first_filled(*(F.get_json_object(body, f"$.{k}") for k in keys))


def placeholder(title: Column, dept: Column, end: str = f"{rules.PLACEHOLDER} for full details.", optional: bool = False) -> Column:
    """`title — department. end`; with optional, no dash without a department."""
    middle = F.when(dept != "", F.concat(F.lit(" — "), dept)).otherwise("") if optional else F.concat(F.lit(" — "), dept)
    return F.concat(title, middle, F.lit(f". {end}"))


def contains_any(c: Column, words) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


# --- Cells of a row, lines of a text ----------------------------------------------------


def first_match(cells: Column, pattern: str) -> Column:
    return F.coalesce(F.get(F.filter(cells, lambda c: c.rlike(pattern)), 0), F.lit(""))


def last_match(cells: Column, pattern: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(cells, lambda c: c.rlike(pattern)), F.lit(-1)), F.lit(""))


def date_cells(cells: Column) -> Column:
    """Parsed dates of the cells that parsing changes; one that is a date already does not count."""
    both = F.transform(cells, lambda c: F.struct(c.alias("c"), parse_date(c).alias("d")))
    return F.filter(F.transform(both, lambda x: F.when(x["d"] != x["c"], x["d"]).otherwise("")), lambda d: d != "")


def lines(c: Column) -> Column:
    """The text's lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(c), r"\R|[\x1c-\x1e]"), strip), lambda x: x != "")


def substantive(c: Column, most: int = 20, longest: int = rules.LONGEST) -> Column:
    """The first lines of over 60 characters, a blank line between them, cut at `longest`."""
    return F.left(F.array_join(F.slice(F.filter(lines(c), lambda x: F.length(x) > rules.LINE), 1, most), "\n\n"), F.lit(longest))


def distinct_paragraphs(parts: Column, longest: int = 2000) -> Column:
    """The paragraphs, the first of those that are equal but for case, cut at `longest`.

    Paragraphs are sorted by lower-cased text and place, so that equal ones stand side by
    side, and the first of each run goes back to its place: n log n for n paragraphs.
    """
    low = lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))
    kept = F.transform(F.filter(parts, lambda x: x != ""), low)
    fresh = lambda s: F.filter(s, lambda r, k: (k == 0) | (F.get(s, k - 1)["low"] != r["low"]))
    firsts = F.transform(_bound(F.sort_array(kept), fresh), lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))
    return F.left(F.array_join(F.transform(F.sort_array(firsts), lambda r: r["x"]), "\n\n"), F.lit(longest))


def longest_block(blocks: Column, longest: int = rules.LONGEST) -> Column:
    """The first longest block of 151 to 4999 characters, cut at `longest`."""
    fit = F.filter(blocks, lambda x: (F.length(x) > 150) & (F.length(x) < 5000))
    return F.left(F.aggregate(fit, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)), F.lit(longest))


def content_paragraphs(parts: Column, longest: int = rules.LONGEST) -> Column:
    """Paragraphs of over 20 characters that do not announce a deadline."""
    return F.left(F.array_join(F.filter(parts, lambda x: (F.length(x) > 20) & ~x.rlike(r"(?i)^(Deadline|Until the Position)")), "\n\n"), F.lit(longest))


def occurrences(c: Column, word: str) -> Column:
    return F.regexp_count(text(c), F.lit(rf"\Q{word}\E")).cast("long")
