"""The query layer over a snapshot: search, filters, sorting, deadline status, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.text import contains_any, deadline_date, text
from postlake.sources.storage import kept

#: Areas by words of title and department, first match wins; lists of our own.
AREAS = (
    ("Medicine & Health", ("medic", "nurs", "health", "clinic", "pharma", "dental", "dentist", "physio")),
    ("Engineering", ("engineer", "electr", "mechanic", "civil", "aerospace")),
    ("Computing & Data", ("comput", "data", "software", "artificial intelligence", "information system", "systems analyst", "programmer")),
    ("Science", ("physics", "chemis", "biolog", "mathemat", "statistic", "scien")),
    ("Business", ("business", "account", "financ", "market", "econom", "manag")),
    ("Law", ("law", "legal")),
    ("Education", ("education", "teaching", "curriculum", "school")),
    ("Humanities", ("history", "philosoph", "languag", "literature", "music", "religio", "translation")),
    ("Social Science", ("social", "psycholog", "politic", "sociolog", "geograph")),
    ("Arts & Design", ("design", "art", "film", "media", "communication")),
    ("Administration", ("officer", "registr", "administrat", "secretar", "clerk", "student", "library", "security")),
)
#: Rules of areas that a table may have: each is a part of one expression.
MAX_RULES = 2_000


def area(title: Column, department: Column) -> Column:
    low = F.lower(F.concat_ws(" ", title, department))
    out = F.when(contains_any(low, AREAS[0][1]), AREAS[0][0])
    for name, words in AREAS[1:]:
        out = out.when(contains_any(low, words), name)
    return out.otherwise("Other")


def area_of_rules(rules: DataFrame, title: Column, department: Column, most: int = MAX_RULES) -> Column:
    """area() by a table of rules(place, area, word): the area of the first place of which a word is in title or department.

    The table is read once, up to `most` rows; more are an error, not a cut. Words are
    compared in any case, rows with a null or empty word say nothing, and places that are
    equal go by their area. Without a rule every posting is Other.
    """
    rows = rules.where("word is not null and word <> '' and area is not null").select("place", "area", F.lower("word").alias("word")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules")
    words: dict[tuple, list[str]] = {}
    for r in rows:
        words.setdefault((r["place"] is None, r["place"] or 0, r["area"]), []).append(r["word"])
    low, out = F.lower(F.concat_ws(" ", title, department)), None
    for key in sorted(words):
        hit = contains_any(low, sorted(set(words[key])))
        out = F.when(hit, key[2]) if out is None else out.when(hit, key[2])
    return F.lit("Other") if out is None else out.otherwise("Other")


def search(df: DataFrame, words: str) -> DataFrame:
    """Rows that have the words, in any case, in title, department, university or description."""
    hay = F.lower(F.concat_ws(" ", text("title"), text("department"), text("university_full"), text("description")))
    return df.where(F.contains(hay, F.lower(F.lit(words))))


def departments(df: DataFrame, university: str) -> DataFrame:
    """The departments to choose from for a university."""
    return df.where(F.col("university") == university).select("department").distinct()


def is_badge(date_added: Column, as_of: Column) -> Column:
    """Added today or yesterday."""
    return F.coalesce(F.datediff(as_of, date_added).between(0, 1), F.lit(False))


def deadline_status(deadline: Column, as_of: Column, urgent: int = 3, soon: int = 7) -> Column:
    """none, closed, urgent, soon or ok; days up to which a deadline is urgent or soon are parameters."""
    left = F.datediff(deadline_date(deadline), as_of)
    return F.when(left.isNull(), "none").when(left < 0, "closed").when(left <= urgent, "urgent").when(left <= soon, "soon").otherwise("ok")


def smart_order(as_of: Column) -> list[Column]:
    """New ones first, then by university, the last added first; ties by id."""
    return [F.desc(is_badge(F.col("date_added"), as_of)), F.asc("university"), F.desc("date_added"), F.asc("id")]


def deadline_order(descending: bool = False) -> list[Column]:
    """By deadline, postings without one last either way."""
    d = deadline_date(F.col("deadline"))
    return [F.desc_nulls_last(d) if descending else F.asc_nulls_last(d), F.asc("id")]


def ranked(df: DataFrame, by: str, groups: dict[str, Column], order: list[Column], tie: str, name: str = "n") -> DataFrame:
    """df with each row's place, from 1, among those of its `by`: by groups in the order of order, then by tie.

    groups: columns under their names, which order reads. The rows, which should be narrow,
    are worked out once and kept; groups are counted and their counts summed, so that a
    task sorts the rows of one group, never all of a `by`.
    """
    rows = kept(df.withColumns(groups))
    keys = [by, *groups]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(tie)))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = rows.join(sizes, same).withColumn(name, F.col("__before") + F.col("__i"))
    return out.drop("__before", "__i", *groups, *(f"__{k}" for k in keys))


def saved(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def detail(df: DataFrame, posting_id: str | Column) -> DataFrame:
    """One posting with the label of its link. posting_id: a value, or a scalar subquery."""
    return df.where(F.col("id") == posting_id).withColumn("apply_label", F.concat(F.lit("Apply on "), F.col("university")))


def view(df: DataFrame, as_of: Column, words: str | None = None, university: str | None = None, department: Sequence[str] | None = None, ranks: Sequence[str] | None = None, areas: Sequence[str] | None = None, saved_ids: DataFrame | None = None, sort: str = "smart") -> DataFrame:
    """Filters together; sort: smart, deadline, deadline_desc or none."""
    if words:
        df = search(df, words)
    if university:
        df = df.where(F.col("university") == university)
    if department:
        df = df.where(F.col("department").isin(*department))
    if ranks:
        df = df.where(F.col("rank").isin(*ranks))
    if areas:
        df = df.where(area(F.col("title"), F.col("department")).isin(*areas))
    if saved_ids is not None:
        df = saved(df, saved_ids)
    orders = {"smart": smart_order(as_of), "deadline": deadline_order(), "deadline_desc": deadline_order(True), "none": []}
    return df.orderBy(*orders[sort]) if orders[sort] else df
