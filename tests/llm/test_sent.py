from postlake.llm.common import SENT_ROW, sent


def test_wide_rows_are_sent_only_while_their_bytes_are_few(spark):
    hinted = lambda df: "Hint" in df._jdf.queryExecution().logical().toString()
    rows = spark.range(10)
    assert hinted(sent(rows, 10)) and not hinted(sent(rows, 9))
    assert hinted(sent(rows, 20, 2 * SENT_ROW)) and not hinted(sent(rows, 10, 2 * SENT_ROW))
