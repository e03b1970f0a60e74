from postlake.plans import registry
from postlake.sources import html as H


def test_the_csv_state_is_written_and_read_in_parts(spark):
    rows = spark.range(0, 40, 1, 4).selectExpr("concat('i', id) as id", "'one\ntwo, \"three\"' as description", "date'2026-03-01' as date_added", "true as is_new")
    back = registry._written(spark, rows)
    assert len(back.inputFiles()) == 4 and {(r.id, r.description) for r in back.collect()} == {(f"i{k}", 'one\ntwo, "three"') for k in range(40)}


def test_parsed_rows_leave_a_worker_before_the_next_ones_are_read(spark):
    class Parsed(list):
        alive = 0

        def __init__(self):
            Parsed.alive += 1
            super().__init__([str(Parsed.alive)])

        def __del__(self):
            Parsed.alive -= 1

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "'x' as html")
    out = H.with_parsed(rows, "html", "t", "texts", lambda _: Parsed()).collect()
    assert [r.id for r in out] == list(range(1000)) and max(int(r.t[0]) for r in out) <= 2 * H.PARSED_ROWS


def test_a_day_s_archive_joins_orders_once(spark, tmp_path, monkeypatch):
    from postlake.plans import archive, postings

    joined, raw = [], postings.raw_postings
    monkeypatch.setattr(postings, "raw_postings", lambda *a: joined.append(a) or raw(*a))
    monkeypatch.setattr(archive, "SOURCES", archive.SOURCES[:2])
    monkeypatch.setattr(archive.sites, "archive", lambda pages, folder: None)
    monkeypatch.setattr(archive.sites, "archived", lambda spark, folder: None)
    _, _, previous = archive.all_archived(spark, "/root/testdata/sf0.001", str(tmp_path))
    plan = previous._jdf.queryExecution().executedPlan().toString()
    # Each of twelve sources joins the last snapshot: it is read, not made again for each.
    assert len(joined) == 1 and plan.count("Scan parquet") == 1 and "Exchange" not in plan
    want = {tuple(r) for s in archive.SOURCES for r in archive.cache(spark, "/root/testdata/sf0.001", s).collect()}
    assert {tuple(r) for r in previous.collect()} == want and want
