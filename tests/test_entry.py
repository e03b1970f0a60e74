import os

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ("flagship", "run_snapshot", "p1_clean", "p2_make_id", "p3_infer_department", "p6_parse_date", "x10_substantive_lines", "x11_distinct_paragraphs", "j3_restore_cached", "v5_area", "w4_first_seen", "u2_eduhk", "u5_hkust", "u7_hkbu", "u11_hsu", "x2_links", "x4_anchor_windows", "x8_pruned_text", "k4_debug_elements", "s6_isolation", "s7e_load_more", "t1_snapshot_state", "p18_date_cell", "v1_smart_sort", "j5_zip_links")


def canon(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df.itertuples(index=False))


def test_names():
    # No session is needed to list queries, and each SQL belongs to a query.
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_like_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    for name in NAMES:
        got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        assert canon(got) == canon(want), name
    assert entry.entry(spark).count() == 12
